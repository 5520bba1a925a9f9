"""Quality rules: an isolation forest over rule statistics, with a threshold from labelled rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from diffspark.llm._common import SPACE, checkpoint

SYMBOLS = "#*$%&|<>"
#: Bins of anomalies from 0 to 1.
BINS = 1 << 16
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_UPPER = bytes(range(65, 91))
_DIGIT = bytes(range(48, 58))
_MARK = b"!?.,;:()[]{}\"'=_/\\@^~`+-"


def statistics(text: str | None) -> tuple[tuple[int, ...], list[float]]:
    """The five base counts of a text, and the shares that the forest looks at; those that are near 0 in most texts by their logarithm, so that some hundredths stand apart from none."""
    text = text or ""
    data = text.encode()
    words = data.split()
    n = len(words)
    word_chars = len(text) - sum(map(text.count, SPACE))
    symbols = sum(map(text.count, SYMBOLS))
    lines = text.split("\n")
    seen, dup = set(), 0
    for line in lines:
        if line in seen:
            dup += bool(line.strip(SPACE))
        else:
            seen.add(line)
    repeat, distinct = 0, n
    if n >= 3:
        index: dict[bytes, int] = {}
        codes = np.array([index.setdefault(w, len(index)) for w in words], "u8")
        distinct = len(index)
        # Distinct words are fewer than 2**21 in any text of under 4 MB; for more, windows are numbered in two steps.
        pairs = np.unique(codes[:-1] * np.uint64(distinct) + codes[1:], return_inverse=True)[1].astype("u8") if distinct >= 1 << 21 else codes[:-1] * np.uint64(distinct) + codes[1:]
        windows = pairs[:-1] * np.uint64(distinct) + codes[2:]
        _, back, count = np.unique(windows, return_inverse=True, return_counts=True)
        twice = count[back] >= 2
        if twice.any():
            covered = np.zeros(n, bool)
            for k in range(3):
                covered[k : n - 2 + k] |= twice
            repeat = int(covered.sum())
    base = (n, word_chars, symbols, dup, repeat)
    size, some = max(len(data), 1), max(n, 1)
    shares = [
        np.log1p(n), word_chars / some, distinct / some, (size - len(data.translate(None, _UPPER))) / size, (size - len(data.translate(None, _MARK))) / some,
        *np.log1p([100 * symbols / some, 100 * dup / max(len(lines), 1), 100 * repeat / some, 100 * (size - len(data.translate(None, _DIGIT))) / size, 100 * data.count(b"!") / some]).tolist(),
    ]
    return base, shares


FEATURES = 10


def path_norm(n: float) -> float:
    """Mean path length of an unsuccessful search among ``n`` rows."""
    return 0.0 if n <= 1 else 1.0 if n <= 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


@dataclass
class Forest:
    """Complete binary trees as arrays: node k has the children 2k+1 and 2k+2; a leaf keeps its rows' expected depth."""

    feature: np.ndarray
    split: np.ndarray
    depth: np.ndarray
    height: int
    rows: int
    threshold: float = 1.0

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** -(mean path / expected path): near 1 for rows that random splits set apart early."""
        total = np.zeros(len(x))
        row = np.arange(len(x))
        for f, s, d in zip(self.feature, self.split, self.depth, strict=True):
            at = np.zeros(len(x), int)
            for _ in range(self.height):
                inner = f[at] >= 0
                at = np.where(inner, 2 * at + 1 + (x[row, np.maximum(f[at], 0)] >= s[at]), at)
            total += d[at]
        return 2.0 ** (-total / len(self.feature) / max(path_norm(self.rows), 1e-9))


def grow(x: np.ndarray, low: np.ndarray, high: np.ndarray, height: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A tree over the rows ``x``, split at a random place of a random feature: feature, split, depth by node.

    Half of the splits, at random, lie between the least and largest value of the node's rows. Half cut off a part of the node's box that holds none of them, the whole box reaching from ``low`` to ``high``; the wider a feature's empty part, the likelier it is taken. So a row that differs in a feature that all of ``x`` share is set apart early.
    """
    width = np.tile(np.maximum(high - low, 1e-12), 2)
    nodes = 2 ** (height + 1) - 1
    feature, split, depth = np.full(nodes, -1), np.zeros(nodes), np.zeros(nodes)
    stack = [(0, 0, x, low, high)]
    while stack:
        k, level, part, a, b = stack.pop()
        if level == height or not len(part):
            depth[k] = level + path_norm(len(part))
            continue
        near, far = part.min(0), part.max(0)
        empty = np.concatenate([near - a, b - far]) / width
        empty[empty < 1e-9] = 0
        wide = np.flatnonzero(far > near)
        if empty.sum() > 0 and (rng.random() < 0.5 or not len(wide)):
            side, f = divmod(int(rng.choice(len(empty), p=empty / empty.sum())), len(a))
            s = max(rng.uniform(far[f], b[f]), np.nextafter(far[f], np.inf)) if side else rng.uniform(a[f], near[f])
        elif len(wide) and len(part) > 1:
            f = int(rng.choice(wide))
            s = rng.uniform(near[f], far[f])
        else:
            depth[k] = level + path_norm(len(part))
            continue
        feature[k], split[k] = f, s
        cut_b, cut_a = b.copy(), a.copy()
        cut_b[f] = cut_a[f] = s
        stack += [(2 * k + 1, level + 1, part[part[:, f] < s], a, cut_b), (2 * k + 2, level + 1, part[part[:, f] >= s], cut_a, b)]
    return feature, split, depth


def isolation_forest(grown: DataFrame, n: int, low: np.ndarray, high: np.ndarray, *, trees: int, rows: int, seed: int) -> Forest:
    """A forest over the ``n`` rows of ``grown(hash, features)``: each tree draws its own ``rows`` of them all (the subsampling that makes an isolation forest), by hash, and is grown in a task of its own."""
    rows = min(rows, n)
    height = max(1, int(np.ceil(np.log2(max(rows, 2)))))
    drawn = lambda t: F.shiftrightunsigned(F.xxhash64("hash", t, F.lit(seed)), 33)
    # So many that fewer than ``rows`` are drawn in no tree, but for one in 10**20; the first of them are taken.
    most = int(min(1.0, (rows + 10 * rows**0.5) / n) * 2**31)
    some = grown.withColumn("tree", F.explode(F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: drawn(t) < most))).withColumn("draw", drawn(F.col("tree")))
    order = W.partitionBy("tree").orderBy("draw", "hash")
    some = some.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= rows)

    def one(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["draw", "hash"])
        t = int(part["tree"].iloc[0])
        return pd.DataFrame([(t, *(c.tolist() for c in grow(np.stack(part["features"].to_numpy()), low, high, height, np.random.default_rng([seed, t]))))], columns=["tree", "feature", "split", "depth"])

    got = some.select("tree", "draw", "hash", "features").groupBy("tree").applyInPandas(one, "tree int, feature array<int>, split array<double>, depth array<double>").orderBy("tree").collect()
    return Forest(*(np.array([r[c] for r in got]) for c in ("feature", "split", "depth")), height, rows)


def rule_statistics(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the base counts (long) and features (array of double) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [statistics(x.as_py()) for x in b.column(1)]
            base = [pa.array([g[0][k] for g in got], pa.int64()) for k in range(len(BASE))]
            yield pa.RecordBatch.from_arrays([b.column(0), *base, pa.array([g[1] for g in got], pa.list_(pa.float64()))], ["doc_id", *BASE, "features"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, " + ", ".join(f"{c} long" for c in BASE) + ", features array<double>")


def scored(rows: DataFrame, forest: Forest, *keep: str) -> DataFrame:
    """The columns ``keep`` of ``rows``, and the anomaly of its features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array(b.column("features").to_pylist()).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(forest.score(x))], [*keep, "anomaly"])

    kinds = dict(rows.dtypes)
    return rows.select(*keep, "features").mapInArrow(run, "".join(f"{c} {kinds[c]}, " for c in keep) + "anomaly double")


def threshold(judged: DataFrame, n_good: int, n_bad: int, keep_good: float) -> float:
    """Of the anomalies of ``judged(good, anomaly)`` the one that best tells good rows from bad ones (share of bad above less share of good above, the least of equal ones), but at least the one below which a share ``keep_good`` of the good rows lies.

    Exact over all rows: equal anomalies are counted first, and summed up within ``BINS`` equal bins, to which the sums of the bins before are added.
    """
    cuts = judged.groupBy("anomaly").agg(F.count_if("good").alias("g"), F.count_if(~F.col("good")).alias("b")).withColumn("bin", F.floor(F.col("anomaly") * BINS))
    before = W.orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    offsets = cuts.groupBy("bin").agg(F.sum("g").alias("_g"), F.sum("b").alias("_b")).select("bin", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("_g", "_b")))
    within = W.partitionBy("bin").orderBy("anomaly").rowsBetween(W.unboundedPreceding, 0)
    sums = cuts.join(offsets, "bin").select("anomaly", (F.sum("g").over(within) + F.col("_g")).alias("g"), (F.sum("b").over(within) + F.col("_b")).alias("b"))
    place = min(n_good - 1, int(np.ceil(keep_good * n_good)))
    gain = (n_bad - F.col("b")) * n_good - (n_good - F.col("g")) * n_bad
    least, best = sums.agg(F.min(F.when(F.col("g") > place, F.col("anomaly"))), F.max(F.struct(gain.alias("gain"), (-F.col("anomaly")).alias("cut")))["cut"]).first()
    return max(least, -best) if n_bad else least


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", among: Column | None = None, keep_good: float = 0.99, trees: int = 100, rows: int = 256, seed: int = 7) -> Forest:
    """A forest over all documents labelled good (of quality 1; over all documents where none is), and the threshold of anomaly. ``among`` restricts the documents that are learnt from.

    One half of the labelled rows, by hash, grows the trees and bounds their box; the other calibrates the ``threshold``. Where a half would be empty, all rows do both. Rows that have more than one label count with the larger one; rows of one id that differ count each, null ids have no label.
    """
    own = docs if among is None else docs.where(among)
    stats = rule_statistics(own, doc_id=doc_id, text=text).select(F.col("doc_id").alias("id"), "features")
    told = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").alias("id")).agg((F.max("quality") == 1).alias("good"))
    hashed = lambda d: d.distinct().withColumn("hash", F.xxhash64("id", "features")).withColumn("half", F.pmod(F.xxhash64("hash", F.lit("half")), F.lit(2)).cast("int"))
    known = checkpoint(hashed(stats.join(told, "id")))
    if known.where("good").isEmpty():
        known = checkpoint(known.union(hashed(stats.withColumn("good", F.lit(True))).select(known.columns)))
    ends = [f(F.col("features")[k]).alias(f"{name}{k}") for name, f in (("low", F.min), ("high", F.max)) for k in range(FEATURES)]
    sizes = {(r["good"], r["half"]): r for r in known.groupBy("good", "half").agg(F.count("*").alias("n"), *ends).collect()}
    halves = {(good, half): [h for h in (0, 1) if (good, h) in sizes and (h == half or (good, 1 - h) not in sizes)] for good in (True, False) for half in (0, 1)}
    n = {k: sum(sizes[k[0], h]["n"] for h in v) for k, v in halves.items()}
    if not n[True, 0]:
        return Forest(np.full((1, 3), -1), np.zeros((1, 3)), np.zeros((1, 3)), 1, 1)
    box = [sizes[good, h] for good in (True, False) for h in halves[good, 0]]
    low, high = (f([[r[f"{name}{k}"] for k in range(FEATURES)] for r in box]) for name, f in (("low", lambda x: np.min(x, 0)), ("high", lambda x: np.max(x, 0))))
    grown = known.where(F.col("good") & F.col("half").isin(halves[True, 0]))
    forest = isolation_forest(grown.select("hash", "features"), n[True, 0], low, high, trees=trees, rows=rows, seed=seed)
    judged = known.where(F.when(F.col("good"), F.col("half").isin(halves[True, 1])).otherwise(F.col("half").isin(halves[False, 1])))
    forest.threshold = threshold(scored(judged, forest, "good"), n[True, 1], n[False, 1], keep_good)
    return forest


def quality(docs: DataFrame, forest: Forest, *, doc_id: str = "doc_id", text: str = "text", min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """Judge every whole text: doc_id, the base counts, base_failed, anomaly (0 to 1), kept.

    base_failed: fewer than ``min_words`` words, or over ``max_repeat_percent`` per cent of them in 3-word windows that the text has twice or more. kept: not base_failed and an anomaly of at most the forest's threshold.

    Defined cases: a null or empty text has no words and fails; repeated rows and null ids give a row each; an empty table gives an empty table; other columns are not read.
    """

    out = scored(rule_statistics(docs, doc_id=doc_id, text=text), forest, "doc_id", *BASE)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("anomaly") <= forest.threshold))
