"""Language identification by bit-sliced Bloom filters of n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from diffspark.llm.samples import first_by_hash_each

_LETTER = regex.compile(r"\p{L}")
#: Byte map for n-grams: A-Z lower case, other ASCII than letters a space; bytes of longer characters as they are.
_MAP = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
UNDETERMINED = "und"


def grams(text: str | None, n: int = 4) -> np.ndarray:
    """The ``n`` bytes at each place of the lower-cased words, as numbers; a word has one space at either end, and runs between words give none."""
    data = np.frombuffer(b" " + b" ".join((text or "").encode().translate(_MAP).split()) + b" ", "u1")
    if len(data) < n:
        return np.zeros(0, "u8")
    out = np.zeros(len(data) - n + 1, "u8")
    inner = np.zeros(len(out), bool)
    for k in range(n):
        part = data[k : k + len(out)]
        out = out << np.uint64(8) | part
        if 0 < k < n - 1:
            inner |= part == 32
    return out[~inner]


def places(grams: np.ndarray, slots: int, hashes: int) -> Iterator[np.ndarray]:
    """The slots of each n-gram, one array for each hash; ``slots`` is a power of two."""
    h = (grams + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    step = (h >> np.uint64(33)) | np.uint64(1)
    for k in range(hashes):
        yield ((h + np.uint64(k) * step) & np.uint64(slots - 1)).astype("i8")


@dataclass
class Filters:
    """Slot s of ``slots`` holds, bit by bit, which languages' filters have it set, so that one read answers for 64 languages; a slot has as many words of 64 bits as the languages need."""

    languages: list[str]
    slots: np.ndarray
    hashes: int
    n: int
    false_rate: np.ndarray

    def masks(self, grams: np.ndarray) -> np.ndarray:
        """Languages that contain each n-gram, as bit masks: a row for each word of 64 languages."""
        out = np.full((len(self.slots), len(grams)), np.iinfo("u8").max, "u8")
        for at in places(grams, self.slots.shape[1], self.hashes):
            for own, word in zip(out, self.slots, strict=True):
                own &= word[at]
        return out

    def decide(self, text: str | None) -> tuple[str, float]:
        """The language whose filter holds most n-grams, after its false positives are taken off, and the share of n-grams that it holds."""
        if not self.languages or not text or not _LETTER.search(text):
            return UNDETERMINED, 0.0
        masks = self.masks(grams(text, self.n))
        total = masks.shape[1]
        if not total:
            return self.languages[0], 0.0
        hits = np.zeros(len(self.languages))
        for word, own in enumerate(masks):
            values, counts = np.unique(own, return_counts=True)
            for k in range(64 * word, min(64 * word + 64, len(hits))):
                hits[k] = counts[(values >> np.uint64(k % 64) & np.uint64(1)) == 1].sum() / total
        share = np.clip((hits - self.false_rate) / (1 - self.false_rate), 0, 1)
        best = int(np.argmax(share))
        return self.languages[best], float(share[best])


def fit(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", among: Column | None = None, per_language: int = 1000, n: int = 4, least_docs: int = 3, ratio: float = 0.2, bits: int = 20, hashes: int = 4) -> Filters:
    """Filters of all languages that ``lang`` names, learnt from at most ``per_language`` documents of each.

    Of rows of one id that differ, the least text and language count. A language contains an n-gram that at least ``least_docs`` of its sampled documents have (all of them, if there are fewer), and a share of them at least ``ratio`` times the largest share in any language: a few foreign passages don't enter a filter. Documents are counted by Spark; the kept pairs are at most those of the sample. ``2**bits`` slots of 64 bits are 8 MB for the default, and for every 64 languages.
    """
    learn = docs.where(F.col(lang).isNotNull() & F.col(doc_id).isNotNull() & (F.lit(True) if among is None else among)).select(F.col(doc_id).alias("id"), F.col(lang).alias("lang"))
    keys = first_by_hash_each(learn, per_language, F.col("id"), "lang")
    sample = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(keys), "id").groupBy("id").agg(F.min("text").alias("text"), F.min("lang").alias("lang"))

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                g = np.unique(grams(t, n)).astype("i8")
                yield pa.RecordBatch.from_arrays([pa.array([y] * len(g), pa.string()), pa.array(g)], ["lang", "gram"])

    sample = sample.select("text", "lang").persist()
    sizes = {r["lang"]: r["n"] for r in sample.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        sample.unpersist()
        return Filters([], np.zeros((1, 1 << bits), "u8"), hashes, n, np.zeros(0))
    names = sorted(sizes)
    number = F.create_map(*(x for k, v in enumerate(names) for x in (F.lit(v), F.lit(k))))
    least = F.create_map(*(x for k, v in sizes.items() for x in (F.lit(k), F.lit(min(v, least_docs)))))
    size = F.create_map(*(x for k, v in sizes.items() for x in (F.lit(k), F.lit(float(v)))))
    counts = sample.mapInArrow(distinct, "lang string, gram long").groupBy("gram", "lang").agg(F.count("*").alias("n")).withColumn("share", F.col("n") / size[F.col("lang")])
    top = counts.groupBy("gram").agg(F.max("share").alias("top"), F.collect_list(F.struct("lang", "n", "share")).alias("all"))
    kept = top.select("gram", "top", F.explode("all").alias("a")).where((F.col("a.n") >= least[F.col("a.lang")]) & (F.col("a.share") >= ratio * F.col("top")))
    table = kept.select("gram", number[F.col("a.lang")].alias("lang")).toPandas()
    sample.unpersist()
    filters = Filters(names, np.zeros((-(-len(names) // 64), 1 << bits), "u8"), hashes, n, np.zeros(len(names)))
    fill = np.zeros(len(names))
    found = table["gram"].to_numpy().astype("u8")[np.argsort(table["lang"].to_numpy(), kind="stable")]
    ends = np.cumsum(np.bincount(table["lang"].to_numpy(), minlength=len(names)))
    for k in range(len(names)):
        g = found[ends[k - 1] if k else 0 : ends[k]]
        own = np.zeros(1 << bits, "u8")
        for at in places(g, 1 << bits, hashes):
            own[at] = 1
        fill[k] = own.mean()
        filters.slots[k // 64] |= own << np.uint64(k % 64)
    filters.false_rate = fill**hashes
    return filters


def language(docs: DataFrame, filters: Filters, *, text: str = "text") -> DataFrame:
    """Predict the language of every whole text: the columns of ``docs`` with lang_pred, score (0 to 1: the share of n-grams that the language's filter holds, false positives taken off); input columns of these two names are replaced.

    Defined cases: a null text and one without a letter are ``und`` with score 0; equal shares go to the first language by name; a text of letters too few for an n-gram has score 0, and any text is ``und`` for a model without languages; repeated rows and null ids give a row each; an empty table gives an empty table.
    """
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    rows = docs.select(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [filters.decide(x.as_py()) for x in b.column(text)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], [*names, "lang_pred", "score"])

    return rows.mapInArrow(run, T.StructType([*(T.StructField(f.name, f.dataType) for f in rows.schema), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
