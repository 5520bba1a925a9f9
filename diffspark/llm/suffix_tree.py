"""Language-model scoring by a probabilistic suffix tree over words."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diffspark.llm._common import checkpoint, partitions, remainder, words
from diffspark.llm._packed import dealt, ids_of, slices, unpack_all
from diffspark.llm.word_tree import word_tree_sums

#: Tokens that a context reaches back at most, and bits of a token's number: a context and the token after it fill one 64-bit number.
DEPTH, BITS = 2, 16
#: The token that ends a text; no word holds a line feed.
END = b"\n"
_sums = np.dtype([("doc", "<i8"), ("known", "<i8"), ("base", "<f8"), ("score", "<f8")])


def low(n: int) -> np.uint64:
    """A mask of ``n`` tokens."""
    return np.uint64((1 << BITS * n) - 1)


def keyed(docs: DataFrame, *, doc_id: str, text: str, held_out: int, most_sent: int = 100_000) -> DataFrame:
    """key, id, text, train of each row. A row's key is its id; of null ids and of ids that several rows have, a 64-bit hash of id and text, so that only rows alike in both share one. Up to ``most_sent`` such ids are sent to all tasks, more are joined by a shuffle."""
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"), (remainder(F.col(doc_id), held_out) != 0).alias("train"))
    several = checkpoint(rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1 and id is not null").select(F.col("id").alias("_id")))
    hashed = F.xxhash64("id", "text", F.lit(held_out))
    if not (n := several.count()):
        return rows.select(F.when(F.col("id").isNull(), hashed).otherwise(F.col("id")).alias("key"), "id", "text", "train")
    again = rows.join(F.broadcast(several) if n <= most_sent else several, F.col("id") == F.col("_id"), "left")
    return again.select(F.when(F.col("id").isNull() | F.col("_id").isNotNull(), hashed).otherwise(F.col("id")).alias("key"), "id", "text", "train")


def pack_words(words: list[bytes], *columns: np.ndarray) -> bytes:
    """Words and a number or more for each, compressed."""
    head = np.array([len(words)], "<i8").tobytes() + np.array([len(w) for w in words], "<u4").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(c.astype("<i8").tobytes() for c in columns) + b"".join(words))


def unpack_words(data: bytes, columns: int) -> tuple[list[bytes], list[np.ndarray]]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    lengths, at = np.frombuffer(raw, "<u4", n, 8), 8 + 4 * n
    out = [np.frombuffer(raw, "<i8", n, at + 8 * n * k) for k in range(columns)]
    ends = at + 8 * n * columns + np.cumsum(lengths, dtype="i8")
    return [raw[e - k : e] for e, k in zip(ends.tolist(), lengths.tolist(), strict=True)], out


def word_buckets(words: list[bytes], n: int) -> Iterator[tuple[int, np.ndarray]]:
    at = np.fromiter((xxhash.xxh64_intdigest(w) % n for w in words), "i8", len(words))
    order = np.argsort(at, kind="stable")
    ends = np.searchsorted(at[order], np.arange(n + 1))
    for k in np.flatnonzero(np.diff(ends)):
        yield int(k), order[ends[k] : ends[k + 1]]


def word_counts(rows: DataFrame, share: float) -> DataFrame:
    """Of the words of a bucket in training texts of ``rows(key, text, train)``: tokens, types, once and twice (words found so often), and words and counts of those that may make up ``share`` of all tokens (found as often as that share of the bucket's own), and of the end, however rare it is.

    A task counts its words and hands them on by bucket, each once for each batch of documents.
    """
    n = partitions(rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found: Counter[bytes] = Counter()
            for x, learn in zip(b.column(1), b.column(2).to_pylist(), strict=True):
                if learn:
                    found.update(words(x.as_py()))
                    found[END] += 1
            own, counts = list(found), np.fromiter(found.values(), "i8", len(found))
            got = [(k, pack_words([own[i] for i in part], counts[part])) for k, part in word_buckets(own, n)]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int32()), pa.array([g[1] for g in got], pa.binary())], ["bucket", "data"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bytes, int] = {}
        for b in batches:
            for x in b.column(1):
                own, (counts,) = unpack_words(x.as_py(), 1)
                for w, c in zip(own, counts.tolist(), strict=True):
                    found[w] = found.get(w, 0) + c
        counts = np.fromiter(found.values(), "i8", len(found))
        top = [(w, c) for w, c in found.items() if c >= share * counts.sum() or w == END]
        sums = [int(x) for x in (counts.sum(), len(counts), (counts == 1).sum(), (counts == 2).sum())]
        yield pa.RecordBatch.from_arrays([*(pa.array([s], pa.int64()) for s in sums), pa.array([[t[0] for t in top]], pa.list_(pa.binary())), pa.array([[t[1] for t in top]], pa.list_(pa.int64()))], ["tokens", "types", "once", "twice", "words", "counts"])

    return rows.mapInArrow(count, "bucket int, data binary").repartitionById(n, F.col("bucket")).mapInArrow(merge, "tokens long, types long, once long, twice long, words array<binary>, counts array<long>")


@dataclass
class Alphabet:
    """The frequent tokens, numbered from 1, the end among them; all others are one symbol. Counts are of training tokens."""

    numbers: dict[bytes, int]
    counts: np.ndarray
    tokens: int
    types: int
    discount: float

    @property
    def other(self) -> int:
        return len(self.numbers) + 1

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10(count + 0.1) - np.log10(self.tokens + 0.1 * (self.types + 1))

    def rare(self, count: np.ndarray) -> np.ndarray:
        """log10 probability of a token among the others: its count less the discount, and for one not found in training, which is the unknown token, all that the discount frees."""
        rest = max(self.tokens - int(self.counts.sum()), 0)
        freed = self.discount * max(self.types - len(self.numbers), 1)
        return np.log10(np.where(count > 0, np.maximum(count - self.discount, 1e-9), freed) / max(rest, freed))


def sequences(texts: pa.Array, numbers: dict[bytes, int], other: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, symbol, number) for each token of the texts, with an end after each: a number has the symbol lowest and up to ``DEPTH`` before it, a text beginning after an end."""
    get, end, codes, sizes = numbers.get, numbers[END], [], []
    for x in texts:
        own = [get(w, other) for w in words(x.as_py())]
        codes += [end] * DEPTH + own + [end]
        sizes.append(len(own) + 1 + DEPTH)
    symbols = np.array(codes, "u8")
    row = np.repeat(np.arange(len(sizes)), sizes)
    out = symbols.copy()
    for k in range(1, DEPTH + 1):
        out[k:] |= symbols[:-k] << np.uint64(BITS * k)
    starts = np.cumsum([0, *sizes[:-1]]) if sizes else np.zeros(0, int)
    keep = np.ones(len(symbols), bool)
    for k in range(DEPTH):
        keep[starts + k] = False
    return row[keep], symbols[keep].astype("i8"), out[keep]


@dataclass
class Tree:
    """For each context length: the kept contexts and what is left for symbols not seen after them, and the seen numbers (context, symbol) with their probability. Logs to base 10."""

    contexts: list[np.ndarray]
    left: list[np.ndarray]
    numbers: list[np.ndarray]
    logs: list[np.ndarray]

    def score(self, numbers: np.ndarray) -> np.ndarray:
        """log10 probability of each number's symbol after the longest kept suffix of its context; of a symbol not seen there, after ever shorter ones."""
        out, todo = np.zeros(len(numbers)), np.arange(len(numbers))
        for k in range(len(self.contexts) - 1, -1, -1):
            if not len(self.numbers[k]):
                continue
            key = numbers[todo] & low(k + 1)
            context = key >> np.uint64(BITS)
            where = np.minimum(np.searchsorted(self.contexts[k], context), len(self.contexts[k]) - 1)
            here = self.contexts[k][where] == context
            at = np.minimum(np.searchsorted(self.numbers[k], key), len(self.numbers[k]) - 1)
            seen = here & (self.numbers[k][at] == key)
            out[todo[seen]] += self.logs[k][at[seen]]
            rest = here & ~seen
            out[todo[rest]] += self.left[k][where[rest]]
            todo = todo[~seen]
        return out


def build_tree(level: np.ndarray, number: np.ndarray, n: np.ndarray) -> Tree:
    """From the counts of the symbols after each kept context. A symbol's probability after a context: its count, and as many more as the context has distinct symbols after it, shared as after the context's longest kept suffix, over their sum (Witten-Bell); the root has its symbols' shares."""
    tree = Tree([], [], [], [])
    for k in range(DEPTH + 1):
        own = np.flatnonzero(level == k)
        own = own[np.argsort(number[own])]
        key, count = number[own], n[own].astype("f8")
        context, first = np.unique(key >> np.uint64(BITS), return_index=True)
        kinds = np.diff(np.append(first, len(key))).astype("f8") * (k > 0)
        total = np.add.reduceat(count, first) if len(key) else np.zeros(0)
        each = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(key))))
        below = 10.0 ** tree.score(key) if k else np.zeros(len(key))
        tree.contexts.append(context)
        tree.left.append(np.log10(np.maximum(kinds, 1e-9) / (total + kinds)))
        tree.numbers.append(key)
        tree.logs.append(np.log10((count + kinds[each] * below) / (total + kinds)[each]))
    return tree


def kept_contexts(rows: DataFrame, alphabet: Alphabet, *, least_share: float, gain: float) -> DataFrame:
    """Counts of the symbols after the contexts that the tree keeps, over all training texts: level, number, n.

    A context counts only if it makes up ``least_share`` of all tokens, so a level has at most 1 / least_share of them, whatever the size of the corpus. It is kept if the symbols after it are distributed otherwise than after the context that is one token shorter: if its count times the Kullback-Leibler divergence is at least ``gain`` nats. The root is always kept.
    """
    numbers, other = alphabet.numbers, alphabet.other

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            own = b.column(1).filter(b.column(2))
            key, n = np.unique(sequences(own, numbers, other)[2], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.view("i8")), pa.array(n.astype("i8"))], ["number", "n"])

    full = rows.mapInArrow(count, "number long, n long").groupBy("number").agg(F.sum("n").alias("n"))
    level = F.explode(F.array(*(F.struct(F.lit(k).alias("level"), F.col("number").bitwiseAND(F.lit((1 << BITS * (k + 1)) - 1)).alias("number")) for k in range(DEPTH + 1))))
    counts = checkpoint(full.select(level.alias("x"), "n").select("x.level", "x.number", "n").groupBy("level", "number").agg(F.sum("n").alias("n")))
    context = F.shiftright("number", BITS)
    totals = counts.groupBy("level", context.alias("context")).agg(F.sum("n").alias("total")).where((F.col("level") == 0) | (F.col("total") >= least_share * alphabet.tokens))
    frequent = counts.withColumn("context", context).join(totals, ["level", "context"])
    shorter = F.when(F.col("level") == 1, F.lit((1 << BITS) - 1))
    for k in range(2, DEPTH + 1):
        shorter = shorter.when(F.col("level") == k, F.lit((1 << BITS * k) - 1))
    parent = frequent.select((F.col("level") + 1).alias("level"), F.col("number").alias("_parent"), F.col("n").alias("_n"), F.col("total").alias("_total"))
    paired = frequent.where("level > 0").withColumn("_parent", F.col("number").bitwiseAND(shorter)).join(parent, ["level", "_parent"])
    divergence = F.sum(F.col("n") * F.log(F.col("n") * F.col("_total") / (F.col("total") * F.col("_n"))))
    kept = paired.groupBy("level", "context").agg(divergence.alias("_gain")).where(F.col("_gain") >= gain).select("level", "context")
    return frequent.join(kept, ["level", "context"], "left_semi").union(frequent.where("level = 0")).select("level", "number", "n")


def rare_sums(rows: DataFrame, alphabet: Alphabet) -> DataFrame:
    """Sums over the tokens of each key's rows that aren't in the alphabet: key, known, base, score.

    Such tokens are handed on by bucket of the word, a word once for each batch with its documents, as compressed numbers; a bucket knows its words' counts and answers with sums for its documents, by bucket of the document. A word of the alphabet would be in very many documents; it has no postings.
    """
    n = partitions(rows)
    frequent = alphabet.numbers

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            codes: dict[bytes, int] = {}
            tokens, sizes = [], []
            for x in b.column(1):
                own = [codes.setdefault(w, len(codes)) for w in words(x.as_py()) if w not in frequent]
                tokens += own
                sizes.append(len(own))
            if not codes:
                continue
            ids = ids_of(b.column(0))
            train = b.column(2).to_numpy(zero_copy_only=False)
            key, times = np.unique(np.array(tokens, "u8") << np.uint64(32) | np.repeat(np.arange(len(ids)), sizes).astype("u8"), return_counts=True)
            del tokens
            word, row = (key >> np.uint64(32)).astype("i8"), (key & np.uint64(0xFFFFFFFF)).astype("i8")
            own_words = list(codes)
            first = np.searchsorted(word, np.arange(len(own_words) + 1))
            total = np.add.reduceat(times * train[row], first[:-1])
            for k, part in word_buckets(own_words, n):
                each = first[part + 1] - first[part]
                posts = np.repeat(first[part] - np.cumsum(each) + each, each) + np.arange(each.sum())
                data = pack_words([own_words[i] for i in part], total[part], each)
                numbers = zstandard.ZstdCompressor(level=1).compress(ids[row[posts]].astype("<i8").tobytes() + times[posts].astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([data], pa.binary()), pa.array([numbers], pa.binary())], ["bucket", "words", "posts"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[bytes, int] = {}
        parts = []
        for b in batches:
            for w, p in zip(b.column(1), b.column(2), strict=True):
                own, (total, each) = unpack_words(w.as_py(), 2)
                parts.append((np.array([codes.setdefault(x, len(codes)) for x in own]), total, each, p.as_py()))
        count = np.zeros(len(codes), "i8")
        for code, total, _, _ in parts:
            count[code] += total
        base, score = alphabet.base(count), alphabet.rare(count)
        out = []
        for code, _, each, p in parts:
            raw = zstandard.ZstdDecompressor().decompress(p)
            size = int(each.sum())
            doc, times = np.frombuffer(raw, "<i8", size), np.frombuffer(raw, "<u4", size, 8 * size)
            word = np.repeat(code, each)
            some, back = np.unique(doc, return_inverse=True)
            rows = np.empty(len(some), _sums)
            rows["doc"] = some
            for f, v in (("known", times * (count > 0)[word]), ("base", times * base[word]), ("score", times * score[word])):
                rows[f] = np.bincount(back, v, len(some))
            out.append(rows)
        rows = np.concatenate([np.empty(0, _sums), *out])
        got = list(dealt(rows, rows["doc"], n))
        yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int32()), pa.array([g[1] for g in got], pa.binary())], ["bucket", "data"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = unpack_all([x for b in batches for x in b.column(1).to_pylist()], _sums)
        doc, back = np.unique(rows["doc"], return_inverse=True)
        sums = [np.bincount(back, rows[f], len(doc)) for f in ("known", "base", "score")]
        yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(sums[0].astype("i8")), pa.array(sums[1]), pa.array(sums[2])], ["key", "known", "base", "score"])

    dealt_out = rows.mapInArrow(index, "bucket int, words binary, posts binary").repartitionById(n, F.col("bucket")).mapInArrow(answer, "bucket int, data binary")
    return dealt_out.repartitionById(n, F.col("bucket")).mapInArrow(total, "key long, known long, base double, score double")


def suffix_tree_scores(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", held_out: int = 10, depth: int = 3, symbol_share: float | None = None, least_share: float = 1e-5, gain: float = 20.0) -> DataFrame:
    """Score every whole text by a probabilistic suffix tree learnt from the documents whose id's crc32 modulo ``held_out`` is not 0.

    Tokens are lower-cased words, then one end. The tree is that of all words, with contexts of up to ``depth`` of them, and grows with the corpus (see ``word_tree_sums``).

    With ``symbol_share`` a small tree is learnt instead: its symbols are the tokens that make up that share of all in training, and one symbol for all others; it predicts a symbol from the longest kept context of up to ``DEPTH`` symbols before it (see ``kept_contexts``, ``build_tree``). A token among the others then has its share of their count, less a discount (that of Good and Turing, n1 / (n1 + 2 n2) from the tokens found once and twice); what that frees is the probability of the unknown token, which stands for every token not found in training, as in the base model. So log P(text) is a sum over the tree, which is small (both shares bound it) and sent to all tasks, and a sum over rare tokens, which are joined with their counts by word.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (the unigram model with 0.1 added to each count), score (both log10).

    Defined cases: a null or empty text is the end alone; repeated rows and null ids give a row each; a null id's crc32 is that of the empty text; without training texts base_score and score are 0; an empty table gives an empty table; other columns are not read.
    """
    rows = keyed(docs, doc_id=doc_id, text=text, held_out=held_out)
    learnt = rows.select("key", "text", "train")
    if symbol_share is None:
        # Rows that share a key are alike: one sum for all of them, and as many rows.
        sums, tokens = word_tree_sums(learnt, depth=depth, gain=gain)
        own = rows.groupBy("key").agg(F.first("id").alias("id"), F.count("*").alias("rows")).join(sums, "key")
        each = own.select("id", *(F.round(F.col(c) / F.col("rows")).cast("long").alias(c) for c in ("n", "known")), *((F.col(c) / F.col("rows")).alias(c) for c in ("base", "score")), F.explode(F.array_repeat(F.lit(0), F.col("rows").cast("int"))))
        some = F.lit(tokens > 0)
        return each.select(
            F.col("id").alias("doc_id"), (remainder(F.col("id"), held_out) == 0).alias("held_out"), F.col("n").alias("n_tokens"), F.col("known").alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
            F.when(some, F.col("base")).otherwise(0.0).alias("base_score"), F.when(some, F.col("score")).otherwise(0.0).alias("score"),
        )
    counted = word_counts(learnt, symbol_share).collect()
    tokens, types, once, twice = (sum(r[c] for r in counted) for c in ("tokens", "types", "once", "twice"))
    top = sorted(((bytes(w), c) for r in counted for w, c in zip(r["words"], r["counts"], strict=True) if c >= symbol_share * tokens or bytes(w) == END), key=lambda x: (-x[1], x[0]))
    top = top or [(END, 0)]
    alphabet = Alphabet({w: i + 1 for i, (w, _) in enumerate(top)}, np.array([c for _, c in top]), tokens, types, min(0.9, max(0.1, once / max(once + 2 * twice, 1))))
    table = kept_contexts(learnt, alphabet, least_share=least_share, gain=gain).toPandas()
    tree = build_tree(table["level"].to_numpy(), table["number"].to_numpy().view("u8"), table["n"].to_numpy())
    numbers, other = alphabet.numbers, alphabet.other

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = np.concatenate([[0], alphabet.base(alphabet.counts), [0]])
        known = np.concatenate([[0], alphabet.counts > 0, [0]])
        for b in slices(batches):
            row, symbol, number = sequences(b.column(1), numbers, other)
            key, back = np.unique(number, return_inverse=True)
            n = len(b.column(1))
            out = [np.bincount(row, minlength=n).astype("i8"), np.bincount(row, known[symbol], n).astype("i8"), np.bincount(row, base[symbol], n), np.bincount(row, tree.score(key)[back], n)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *(pa.array(x) for x in out)], ["key", "id", "n", "known", "base", "score"])

    # Rows that share a key are alike: one sum for all of them, and as many rows.
    scored = rows.select("key", "text", "id").mapInArrow(score, "key long, id long, n long, known long, base double, score double")
    own = scored.groupBy("key").agg(F.first("id").alias("id"), F.first("n").alias("n_tokens"), *(F.first(c).alias(f"_{c}") for c in ("known", "base", "score")), F.count("*").alias("rows"))
    out = own.join(rare_sums(learnt, alphabet), "key", "left").na.fill(0, ["known", "base", "score"])
    out = out.select("id", "n_tokens", *(F.col(f"_{c}").alias(f"_{c}") for c in ("known", "base", "score")), *((F.col(c) / F.col("rows")).alias(c) for c in ("known", "base", "score")), F.explode(F.array_repeat(F.lit(0), F.col("rows").cast("int"))))
    some = F.lit(tokens > 0)
    return out.select(
        F.col("id").alias("doc_id"), (remainder(F.col("id"), held_out) == 0).alias("held_out"), "n_tokens", (F.col("_known") + F.round("known").cast("long")).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        F.when(some, F.col("_base") + F.col("base")).otherwise(0.0).alias("base_score"), F.when(some, F.col("_score") + F.col("score")).otherwise(0.0).alias("score"),
    )
