"""Periodic runs of words: maximal pairs from the LCP-interval tree."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from diffspark.llm._packed import slices

#: Words whose suffixes are sorted at a time; a longer text is sorted alone.
SORTED = 1 << 20
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def least_common(least_length: int, least_exponent: int) -> int:
    """The shortest common prefix of the two suffixes that begin a run and its second period."""
    return min(max(least_length - q, (least_exponent - 1) * q) for q in range(1, least_length + 1))


def suffix_order(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of ``x`` in order, by prefix doubling, and the common prefix of each with the one before (0 for the first; one more 0 at the end)."""
    n = len(x)
    rank = np.unique(x, return_inverse=True)[1].astype("i8")
    levels, k = [rank], 1
    while n and rank.max() < n - 1:
        after = np.zeros(n, "i8")
        after[: n - k] = rank[k:] + 1
        rank = np.unique(rank * (n + 1) + after, return_inverse=True)[1].astype("i8")
        levels.append(rank)
        k *= 2
    order = np.argsort(rank)
    common = np.zeros(n + 1, "i8")
    one, two = order[:-1].copy(), order[1:].copy()
    for level in reversed(range(len(levels) - 1)):
        at = np.flatnonzero((one < n) & (two < n))
        same = at[levels[level][one[at]] == levels[level][two[at]]]
        common[1 + same] += 1 << level
        one[same] += 1 << level
        two[same] += 1 << level
    return order, common


class Group:
    """The places of one LCP interval. As long as all have the same word on their left (``left``), no two of them begin a maximal pair, and they are one unsorted list of that class."""

    __slots__ = ("at", "left", "sorted")

    def __init__(self, place: int, left: int):
        self.at, self.left, self.sorted = [place], left, True


def joined(a: Group, b: Group, common: int, left: list[int], least_length: int, least_exponent: int, found: dict) -> Group:
    """Two children of an interval of common prefix ``common`` as one group; maximal pairs between them that are runs go to ``found``.

    The two places that begin a run and its second period are next to each other among all places of their interval: a place between would give the stretch a smaller period. So each place of the smaller group meets its two neighbours in the larger one alone.
    """
    if len(a.at) < len(b.at):
        a, b = b, a
    if a.left == b.left is not None:
        a.at += b.at
        a.sorted = False
        return a
    if not a.sorted:
        a.at.sort()
        a.sorted = True
    at, widest = a.at, common // (least_exponent - 1)
    for x in b.at:
        k = bisect_left(at, x)
        for j in (k - 1, k):
            if 0 <= j < len(at) and left[at[j]] != left[x]:
                period = abs(x - at[j])
                if period <= widest and common + period >= least_length:
                    key = (min(x, at[j]), common + period)
                    found[key] = min(period, found.get(key, period))
    if len(b.at) * 16 < len(at):
        for x in b.at:
            insort(at, x)
    else:
        at += b.at
        at.sort()
    a.left = None
    return a


def maximal_runs(order: list[int], common: list[int], left: list[int], least: int, least_length: int, least_exponent: int) -> dict[tuple[int, int], int]:
    """Runs as (start, length): period, from the intervals of common prefix ``least`` or more, bottom up."""
    found: dict[tuple[int, int], int] = {}
    open_: list[tuple[int, Group]] = []
    for k, place in enumerate(order):
        after = common[k + 1]
        if not open_ and after < least:
            continue
        group = Group(place, left[place])
        while open_ and open_[-1][0] >= after:
            depth, before = open_.pop()
            group = joined(before, group, depth, left, least_length, least_exponent, found)
        if after >= least:
            open_.append((after, group))
    return found


def runs_of(texts: list[list[bytes]], least_length: int, least_exponent: int) -> list[list[tuple[int, int, int]]]:
    """Of each list of words, its runs (start, length, period) by start, then period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    least, number = least_common(least_length, least_exponent), {}
    sizes = np.fromiter(map(len, texts), "i8", len(texts))
    x = np.fromiter((number.setdefault(w, len(number)) for t in texts for w in t), "i8", int(sizes.sum()))
    ends = np.cumsum(sizes)
    begins = ends - sizes
    # Only a text that repeats some ``least`` words has an interval that deep; hashes of all such windows tell those without.
    h = (x.astype("u8") + np.uint64(1)) * _PRIME
    width = 1
    while width < least:
        step = min(width, least - width)
        h = (h[: len(h) - step] ^ (h[: len(h) - step] >> np.uint64(29))) * _PRIME + h[step:]
        width += step
    doc = np.repeat(np.arange(len(texts)), sizes)
    inside = np.flatnonzero(np.arange(len(h)) + least <= ends[doc[: len(h)]])
    keys = h[inside] ^ (doc[inside].astype("u8") * np.uint64(0xD6E8FEB86659FD93))
    by = np.argsort(keys, kind="stable")
    twice = by[1:][keys[by[1:]] == keys[by[:-1]]]
    some = np.unique(doc[inside[twice]])
    at = 0
    while at < len(some):
        upto = at + 1
        while upto < len(some) and sizes[some[at : upto + 1]].sum() <= SORTED:
            upto += 1
        part = some[at:upto]
        at = upto
        # Each text ends with a number of its own, so that no common prefix goes past it.
        body = np.concatenate([y for k, d in enumerate(part) for y in (x[begins[d] : ends[d]] + len(part), np.array([k]))])
        left = np.empty(len(body), "i8")
        left[1:], left[0] = body[:-1], -1
        order, common = suffix_order(body)
        starts = np.cumsum(sizes[part] + 1) - sizes[part] - 1
        found = maximal_runs(order.tolist(), common.tolist(), left.tolist(), least, least_length, least_exponent)
        places = np.fromiter((s for s, _ in found), "i8", len(found))
        for k, ((start, length), period) in zip(np.searchsorted(starts, places, "right") - 1, found.items(), strict=True):
            out[part[k]].append((start - int(starts[k]), length, period))
    for got in out:
        got.sort(key=lambda r: (r[0], r[2]))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by a space, without those that a run holds after its first period."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return b" ".join(words[k] for k in np.flatnonzero(keep))


def periodic_runs(docs: DataFrame, *, text: str = "text", least_length: int = 24, least_exponent: int = 3) -> DataFrame:
    """Find the periodic runs in the words of every whole text: the columns of ``docs``, ``runs`` (array of start, length, period, by start, then period; words from 0) and ``collapsed`` (the words outside any run or in a run's first period, joined by a space); input columns of these two names are replaced.

    A run is a stretch of words with smallest period q and at least max(``least_length``, ``least_exponent`` * q) words that no neighbouring word extends. For each text a suffix array gives the LCP-interval tree, which is walked from its leaves; an interval's places are kept by the word on their left, and a maximal pair (places with other words to the left and right of what they share) whose distance is at most 1 / (``least_exponent`` - 1) of what it shares is a run as it stands. Intervals shallower than any run needs are not built. Texts are worked on where they lie; nothing is shuffled. ``least_exponent`` is 2 at least.

    Defined cases: words are cut at ASCII white space; a null or empty text has none, no runs and an empty ``collapsed``; repeated rows and null ids give a row each; an empty table gives an empty table. A text's words must fit in a task.
    """
    if least_exponent < 2:
        raise ValueError("least_exponent is at least 2")
    names = [c for c in docs.columns if c not in ("runs", "collapsed")]
    rows = docs.select(*names)
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = [(t or "").encode().split() for t in b.column(names.index(text)).to_pylist()]
            got = runs_of(texts, least_length, least_exponent)
            spans = pa.array([[{"start": s, "length": n, "period": q} for s, n, q in g] for g in got], pa.list_(run))
            kept = pa.array([collapsed(t, g).decode() for t, g in zip(texts, got, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, spans, kept], [*names, "runs", "collapsed"])

    kind = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
    return rows.mapInArrow(work, T.StructType([*rows.schema, T.StructField("runs", T.ArrayType(kind)), T.StructField("collapsed", T.StringType())]))


def looped(text, crc):
    """The words of a text joined by a space; where ``crc`` ends in 0, those from word a = n mod g on repeat the p words from a, with g the rest of ``crc``'s digits and p = 1 + (n - a) div (3 + g mod 8)."""
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))

    def loop(w):
        n, g = F.size(w).cast("long"), F.floor(crc / 10)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        index = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.when(i >= a, a + (i - a) % p).otherwise(i))
        return F.when(n > 0, F.array_join(F.transform(index, lambda i: F.get(w, i.cast("int"))), " ")).otherwise("")

    return F.when(crc % 10 == 0, F.get(F.transform(F.array(words), loop), 0)).otherwise(text)
