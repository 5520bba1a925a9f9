"""A probabilistic suffix tree over all words, its counts dealt out by context."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diffspark.llm._common import checkpoint, partitions, trim, words
from diffspark.llm._packed import bucket, dealt, ids_of, mix, slices, unpack_all

#: The token that ends a text; no word holds a line feed.
END = b"\n"
#: Buckets, at most, that the positions after one word are dealt out to.
SPLITS = 32
#: Positions, about, that a task works on at a time, and twice as many at most but for those after one context of full length.
PIECE = 200_000
_whole = np.dtype([("doc", "<i8"), ("n", "<i8"), ("known", "<i8"), ("base", "<f8"), ("score", "<f8")])
_part = np.dtype([("doc", "<i8"), ("score", "<f8")])


def squeeze(*columns: np.ndarray) -> bytes:
    """Columns of whole numbers, compressed byte by byte of their digits, each byte apart: upper ones that are 0 throughout are left out."""
    pack, head, out = zstandard.ZstdCompressor(level=1), [], []
    for c in columns:
        planes = np.ascontiguousarray(c).view("u1").reshape(len(c), c.dtype.itemsize).T
        top = len(planes)
        while top and not planes[top - 1].any():
            top -= 1
        parts = [pack.compress(planes[j].tobytes()) for j in range(top)]
        head += [len(c), len(planes), top, *map(len, parts)]
        out += parts
    return np.array([len(head), *head], "<u4").tobytes() + b"".join(out)


def expand(data: bytes) -> list[np.ndarray]:
    unpack, size = zstandard.ZstdDecompressor(), int(np.frombuffer(data, "<u4", 1)[0])
    head, at, out = iter(np.frombuffer(data, "<u4", size, 4).tolist()), 4 + 4 * size, []
    for n in head:
        width, top = next(head), next(head)
        column = np.zeros((n, width), "u1")
        for j in range(top):
            length = next(head)
            column[:, j] = np.frombuffer(unpack.decompress(data[at : at + length]), "u1")
            at += length
        out.append(column.view(f"<i{width}")[:, 0])
    return out


def squeeze_small(columns: list[np.ndarray], *others: np.ndarray) -> bytes:
    """``squeeze`` of others, and of columns of numbers from 0 to 2^53, most of them small: a byte for each tells those below 128, and the highest two bits and the place of the highest one of others, whose lower bits come apart. So a frequent number takes about as many bits as its share tells, and ``squeeze`` would spend some on bytes that say little."""
    out = []
    for c in columns:
        large = np.flatnonzero(c > 127)
        lead, rest = c.astype("u1"), c[large].astype("i8")
        bits = np.frexp(rest.astype("f8"))[1].astype("i8") - 2
        lead[large] = 116 + 2 * bits + (rest >> bits & 1)
        out.append(lead)
        while len(rest):
            out.append((rest & (1 << bits) - 1 & 255).astype("u1"))
            more = np.flatnonzero(bits > 8)
            rest, bits = (rest & (1 << bits) - 1)[more] >> 8, bits[more] - 8
        out.append(np.zeros(0, "u1"))
    return squeeze(*out, *others)


def expand_small(data: bytes, n: int) -> list[np.ndarray]:
    """The ``n`` columns that ``squeeze_small`` has coded, of 4 bytes where that holds them, and the others."""
    parts, out = iter(expand(data)), []
    for _ in range(n):
        lead = next(parts).view("u1")
        large = np.flatnonzero(lead > 127)
        at, bits = lead[large].astype("i8"), (lead[large].astype("i8") - 116) >> 1
        value, place, shift = (2 | at & 1) << bits, np.arange(len(large)), 0
        while len(part := next(parts)):
            value[place] |= part.view("u1").astype("i8") << shift
            more = np.flatnonzero(bits > 8)
            place, bits, shift = place[more], bits[more] - 8, shift + 8
        column = lead.astype("i4" if value.max(initial=0) < 1 << 31 else "i8")
        column[large] = value
        out.append(column)
    return [*out, *parts]


def squeeze_words(own: list[bytes]) -> bytes:
    """No word holds a white-space byte but the end, which is stored as the empty word."""
    return zstandard.ZstdCompressor(level=1).compress(b"\n".join(b"" if w == END else w for w in own))


def expand_words(data: bytes) -> list[bytes]:
    return [w or END for w in zstandard.ZstdDecompressor().decompress(data).split(b"\n")]


@dataclass
class Root:
    """Sums over the training tokens, and the two models that need no context. ``types``: distinct tokens; ``discount`` is taken off each token's count, for all tokens not found in training, which are the unknown token."""

    tokens: int
    types: int
    discount: float

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10(count + 0.1) - np.log10(self.tokens + 0.1 * (self.types + 1))

    def share(self, count: np.ndarray) -> np.ndarray:
        return np.where(count > 0, count - self.discount, self.discount * self.types) / max(self.tokens, 1)

    def idle(self, count: np.ndarray, gain: float) -> np.ndarray:
        """Whether a word is so rare that no context that holds it can have ``gain`` nats: one found m times has m * log(tokens / m) at most, which grows with m up to tokens / e."""
        return (count == 0) | (count * np.e <= self.tokens) & (count * np.log(max(self.tokens, 1) / np.maximum(count, 1)) < 0.999 * gain)

    def last(self, count: np.ndarray, gain: float) -> np.ndarray:
        """Whether no context that goes on before this word can have ``gain`` nats: one found m times, that without its first token W times, has m * log(W / m) at most, so W / e at most, and W is at most the word's count."""
        return count < 0.999 * np.e * gain


def encoded(rows: DataFrame, n: int) -> DataFrame:
    """The texts of ``rows(key, text, train)`` in batches: batch, bucket (null), data (a number for each token, the end after each text; keys, train, sizes), words (the batch's words, one list for each of ``n`` buckets of words; the r-th of bucket k has number r * n + k, and is no rarer in the batch than the next), counts (theirs in training texts)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for k, b in enumerate(slices(batches)):
            codes: dict[bytes, int] = {END: 0}
            tokens, sizes = [], []
            for x in b.column(1):
                own = [codes.setdefault(w, len(codes)) for w in words(x.as_py())]
                tokens += own
                tokens.append(0)
                sizes.append(len(own) + 1)
            code, size = np.array(tokens, "i8"), np.array(sizes, "i8")
            del tokens
            train = b.column(2).to_numpy(zero_copy_only=False).astype("i1")
            listed = list(codes)
            at = np.fromiter((xxhash.xxh64_intdigest(w) % n for w in listed), "i8", len(listed))
            order = np.lexsort((-np.bincount(code, minlength=len(listed)), at))
            count = np.bincount(code, np.repeat(train, size), len(order)).astype("i8")[order]
            ends = np.searchsorted(at[order], np.arange(n + 1))
            number = np.empty(len(order), "i8")
            number[order] = (np.arange(len(order)) - ends[at[order]]) * n + at[order]
            some = np.flatnonzero(np.diff(ends)).tolist()
            lists = [squeeze_words([listed[i] for i in order[ends[j] : ends[j + 1]]]) for j in some]
            counts = [squeeze(count[ends[j] : ends[j + 1]]) for j in some]
            data = squeeze_small([number[code]], ids_of(b.column(0)), train, size)
            yield pa.RecordBatch.from_arrays([pa.array([first + k]), pa.array([data], pa.binary()), pa.array([some], pa.list_(pa.int32())), pa.array([lists], pa.list_(pa.binary())), pa.array([counts], pa.list_(pa.binary()))], ["batch", "data", "buckets", "words", "counts"])
        trim()

    return rows.select("key", "text", "train").mapInArrow(run, "batch long, data binary, buckets array<int>, words array<binary>, counts array<binary>")


def numbered_words(batches: DataFrame, n: int) -> DataFrame:
    """For each batch and bucket of words, what the batch asks about its own: batch, bucket, data (each word's rank by count within the bucket, and its count in all training texts); and a row of sums for each bucket: tokens, types, once, twice (words found so often)."""
    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[bytes, int] = {}
        asked, at = [], 0
        for p in parts:
            for batch, k, w, c in zip(*(p.column(j).to_pylist() for j in range(4)), strict=True):
                at = k
                own = np.array([codes.setdefault(x, len(codes)) for x in expand_words(w)], "i8")
                asked.append((batch, own, expand(c)[0]))
        total = np.zeros(len(codes), "i8")
        for _, own, c in asked:
            total[own] += c
        rank = np.empty(len(codes), "i8")
        rank[np.argsort(-total, kind="stable")] = np.arange(len(codes))
        for batch, own, _ in asked:
            yield answer([batch], [at], [squeeze_small([rank[own], total[own]])], [None] * 4)
        yield answer([None], [at], [None], [int(x) for x in (total.sum(), (total > 0).sum(), (total == 1).sum(), (total == 2).sum())])
        trim()

    def answer(batch: list, at: list, data: list, sums: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(batch, pa.int64()), pa.array(at, pa.int32()), pa.array(data, pa.binary()), *(pa.array([s], pa.int64()) for s in sums)], ["batch", "bucket", "data", *names])

    names = ["tokens", "types", "once", "twice"]
    asked = batches.select("batch", F.explode(F.arrays_zip("buckets", "words", "counts")).alias("x")).select("batch", "x.buckets", "x.words", "x.counts")
    return asked.repartitionById(n, F.col("buckets")).mapInArrow(count, "batch long, bucket int, data binary, tokens long, types long, once long, twice long")


def positions(batches: DataFrame, numbers: DataFrame, root: Root, depth: int, gain: float, n: int) -> DataFrame:
    """Every token that a context may tell, with the ``depth`` tokens before it, dealt out by the word before it: bucket, data, more (words and counts after the words that are dealt out over several buckets); and, by bucket of the text, sums that need no context: bucket, sums. A token before which a word stands that no kept context can hold (``Root.idle``) needs no context beyond that word, which is 0.

    Positions after a frequent word go to several buckets, by the word before that. Each of these is told all words that follow the frequent one in the batch, with their counts, so it knows as much of the frequent word as a single bucket would.
    """
    def deal(batch: int, data: bytes, own: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes | None, bytes | None, bytes | None]]:
        code, keys, train, size = expand_small(data, 1)
        found = {k: expand_small(x, 2) for k, x in sorted(own)}
        # A number from 1 for each word, the same in all batches and small for frequent words.
        ident = np.concatenate([rank.astype("i8") * n + k + 1 for k, (rank, _) in found.items()])
        ident = ident.astype("<i4" if ident.max() < 1 << 31 else "<i8")
        count = np.concatenate([c for _, c in found.values()]).astype("i8")
        first = np.zeros(n, "i8")
        first[[*found]] = np.cumsum([0, *(len(c) for _, c in found.values())])[:-1]
        code = first[code % n] + code // n
        row = np.repeat(np.arange(len(keys)), size)
        base, share, c, idle = root.base(count), np.log10(root.share(count)), count[code], root.idle(count, gain)
        # A text begins after ends alone.
        end, place = code[-1], np.arange(len(code)) - np.repeat(np.cumsum(size) - size, size)
        before = [np.where(place >= j, np.roll(code, j), end) for j in range(1, depth + 1)]
        alone = idle[before[0]]
        whole = np.empty(len(keys), _whole)
        whole["doc"], whole["n"] = keys, size
        whole["known"], whole["base"], whole["score"] = (np.bincount(row, x, len(keys)) for x in (c > 0, base[code], np.where(alone, share[code], 0.0)))
        for k, x in dealt(whole, whole["doc"], n):
            yield k, None, None, x
        split = np.where(idle, 1, np.clip(-(-2 * count * n // max(root.tokens, 1)), 1, SPLITS))
        s = split[before[0]]
        part = bucket(ident[before[min(1, depth - 1)]], 1 << 30).astype("i8") % s
        at = np.where(alone, n, bucket(ident[before[0]].astype("i8") * SPLITS + part, n).astype("i8"))
        del part, place, c
        # What follows frequent words, for all buckets that hold positions after them.
        far = np.flatnonzero((s > 1) & (train[row] > 0))
        pair, times = np.unique(before[0][far].astype("i8") << 32 | code[far], return_counts=True)
        often = np.flatnonzero(split > 1)
        begins, ends = np.searchsorted(pair, often << 32), np.searchsorted(pair, (often + 1) << 32)
        told: dict[int, list[np.ndarray]] = {}
        for w, a, b in zip(often.tolist(), begins.tolist(), ends.tolist(), strict=True):
            for k in set(bucket(int(ident[w]) * SPLITS + np.arange(split[w]), n).tolist()) if b > a else ():
                told.setdefault(k, []).append(np.arange(a, b))
        last, numbers = root.last(count, gain), [np.where(idle, 0, ident)[x] for x in before]
        for j in range(1, depth):
            numbers[j][(numbers[j - 1] == 0) | last[before[j - 1]]] = 0
        # By the word before, in the texts' order after each.
        order = np.argsort(at << 32 | before[0], kind="stable")
        ends = np.searchsorted(at[order], np.arange(n + 1))
        for k in sorted({*np.flatnonzero(np.diff(ends)).tolist(), *told}):
            here = order[ends[k] : ends[k + 1]]
            more = np.concatenate(told.get(k, [np.zeros(0, "i8")]))
            heads, tails = pair[more] >> 32, pair[more] & 0xFFFFFFFF
            # In the order of the words' numbers, in which the other side finds them.
            said = np.unique(np.concatenate([code[here], tails]))
            said = said[np.argsort(ident[said])]
            docs, doc = np.unique(row[here], return_inverse=True)
            start = np.flatnonzero(np.diff(before[0][here], prepend=-1))
            step = np.diff(doc, prepend=0)
            step[start] = doc[start]
            sizes = np.diff(start, append=len(here))
            data = squeeze_small([step, sizes, *(x[here] for x in numbers[1:]), ident[code[here]], count[said]], numbers[0][here[start]], np.diff(keys[docs], prepend=0), train[docs])
            yield k, data, squeeze_small([ident[tails], times[more]], ident[heads]), None

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: dict[int, bytes] = {}
        own: dict[int, list[tuple[int, bytes]]] = {}
        for p in parts:
            for batch, k, x in zip(*(p.column(j).to_pylist() for j in range(3)), strict=True):
                if k is None:
                    texts[batch] = x
                else:
                    own.setdefault(batch, []).append((k, x))
        for batch, x in texts.items():
            got = list(deal(batch, x, own.pop(batch)))
            for a in range(0, len(got), 64):
                part = got[a : a + 64]
                yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in part], pa.int32()), *(pa.array([g[j] for g in part], pa.binary()) for j in (1, 2, 3))], ["bucket", "data", "more", "sums"])
        trim()

    both = batches.select("batch", F.lit(None).cast("int").alias("bucket"), "data").union(numbers.where("batch is not null").select("batch", "bucket", "data"))
    return both.repartitionById(n, F.pmod(F.xxhash64("batch"), F.lit(n)).cast("int")).mapInArrow(run, "bucket int, data binary, more binary, sums binary")


def dense(context: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Numbers from 0 of the contexts that are longer by the word ``before``."""
    word = np.unique(before, return_inverse=True)[1]
    return np.unique(context << np.int64(32) | word, return_inverse=True)[1]


def level_shares(context: np.ndarray, word: np.ndarray, weight: np.ndarray, count: np.ndarray, whole: np.ndarray, below: np.ndarray, gain: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One level of the tree. Rows are (context, word) with a weight; ``count``, ``whole``: how often the word follows the context that is one token shorter, and any token does; ``below``: the word's share after that one. Returns for each row the same three of its own context."""
    key, at, back = np.unique(context << np.int64(32) | word, return_index=True, return_inverse=True)
    n = np.bincount(back, weight, len(key))
    own = context[at]
    total, kinds = np.bincount(own, n), np.bincount(own, n > 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        nats = np.where(n > 0, n * np.log(n * whole[at] / (total[own] * count[at])), 0.0)
    kept = (np.bincount(own, nats) >= gain) & (total > 0)
    share = np.where(kept[own], (n + kinds[own] * below[at]) / np.maximum(total + kinds, 1)[own], below[at])
    return n[back], total[own][back], share[back]


def tally(columns: list[np.ndarray], times: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct rows of the columns, and the sums of ``times`` over each."""
    names = [str(i) for i in range(len(columns))]
    table = pa.table([pa.array(x) for x in (*columns, times)], [*names, "n"]).group_by(names, use_threads=False).aggregate([("n", "sum")])
    return tuple(table[c].to_numpy() for c in (*names, "n_sum"))


def token_shares(before: list[np.ndarray], w: np.ndarray, train: np.ndarray, told: dict[int, tuple[np.ndarray, ...]], count: np.ndarray, root: Root, gain: float, *, piece: int = PIECE, level: int = 0) -> np.ndarray:
    """The tree's share of each token ``w`` after those ``before`` it, nearest first; ``count`` holds each token's. ``told``: counts by length of the context less one (its words, the token after it, how often); positions after a word that has some, or a longer context where any has, don't count themselves.

    More than twice ``piece`` positions are cut by ``level`` + 2 words before them, after what follows each ``level`` + 1 words has been counted for all parts. So only positions after one context of full length can be more at a time.
    """
    own = train & ~np.isin(before[0], np.unique(told[0][0])) if not level else train
    if len(w) > 2 * piece and level + 1 < len(before):
        found = tally([x[own] for x in (*before[: level + 1], w)], np.ones(np.count_nonzero(own), "i1"))
        told = told | {level: found if level else tuple(np.concatenate([x, y]) for x, y in zip(told[0], found, strict=True))}
        key, pieces, out = before[0].astype("u8"), 1 + len(w) // piece, np.empty(len(w))
        for x in before[1 : level + 2]:
            key = mix(key) + x.astype("u8")
        of = bucket(key, pieces).astype("u4")
        del key, own, found
        for r in range(pieces):
            here = np.flatnonzero(of == r)
            out[here] = token_shares([x[here] for x in before], w[here], train[here], told, count, root, gain, piece=piece, level=level + 1)
        return out
    size, none = len(w), np.zeros(len(w), bool)
    every = np.concatenate([w, *(t[-2] for t in told.values())]).astype("i8")
    context, live, k, total = np.zeros(len(every), "i8"), np.arange(len(every)), count[every], np.full(len(every), float(root.tokens))
    out = root.share(k)
    share = out
    for i, x in enumerate(before):
        x = np.concatenate([x, *(t[i] if i <= j else np.zeros(len(t[-1]), "i8") for j, t in told.items())])
        weight = np.concatenate([none if i < level else own, *(t[-1] if i == j else np.zeros(len(t[-1]), "i8") for j, t in told.items())])
        on = np.flatnonzero(x[live] > 0)
        live = live[on]
        context = dense(context[on], x[live])
        k, total, share = level_shares(context, every[live], weight[live], k[on], total[on], share[on], gain)
        out[live] = share
        if not i:
            own = train
    return out[:size]


def contextual(dealt_out: DataFrame, root: Root, depth: int, gain: float, n: int) -> DataFrame:
    """What each bucket's tokens add to their texts' scores, by bucket of the text: bucket, sums, score."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, docs, trains, told, symbols = [], [], [], [], [[] for _ in range(depth + 1)]
        n_docs = 0
        for p in parts:
            for i in range(p.num_rows):
                at, data, more, sums = (p.column(j)[i].as_py() for j in range(4))
                if sums is not None:
                    yield answer(at, sums, None)
                    continue
                step, sizes, *own, count, heads, keys, train = expand_small(data, depth + 3)
                b, times, a = expand_small(more, 2)
                told.append((a, b, times))
                counts.append((np.unique(np.concatenate([own[-1], b])), count))
                start = np.cumsum(sizes) - sizes
                doc = np.cumsum(step, dtype="i4")
                doc -= np.repeat(doc[start] - step[start].astype("i4"), sizes)
                trains.append(train[doc] > 0)
                docs.append((doc + np.int32(n_docs), np.cumsum(keys)))
                n_docs += len(keys)
                for s, x in zip(symbols, (np.repeat(heads, sizes), *own), strict=True):
                    s.append(x)
            del p
        if not docs:
            return
        before = []
        while symbols:
            before.append(np.concatenate(symbols.pop(0)))
        word = before.pop()
        train = np.concatenate(trains)
        told = tally([np.concatenate([t[j] for t in told]) for j in (0, 1)], np.concatenate([t[2] for t in told]))
        names, at = np.unique(np.concatenate([x for x, _ in counts]), return_index=True)
        count = np.concatenate([x for _, x in counts])[at].astype("i8")
        del trains, counts
        # What follows a word is worked out alone, some words at a time.
        pieces = 1 + len(word) // PIECE
        of, of_told = (x // n % pieces for x in (before[0], told[0]))
        out = np.empty(len(word))
        for r in range(pieces):
            here, there = np.flatnonzero(of == r), np.flatnonzero(of_told == r)
            a, b, times = (x[there] for x in told)
            out[here] = token_shares([x[here] for x in before], np.searchsorted(names, word[here]), train[here], {0: (a, np.searchsorted(names, b), times)}, count, root, gain)
            if not r % 4 or len(here) > 2 * PIECE:
                trim()
        del before, word, train, of, told, names, count
        doc, keys = np.concatenate([d for d, _ in docs]), np.concatenate([x for _, x in docs])
        some, back = np.unique(keys, return_inverse=True)
        rows = np.empty(len(some), _part)
        rows["doc"], rows["score"] = some, np.bincount(back[doc], np.log10(out, out=out), len(some))
        for at, x in dealt(rows, rows["doc"], n):
            yield answer(at, None, x)
        trim()

    def answer(at: int, sums: bytes | None, score: bytes | None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([sums], pa.binary()), pa.array([score], pa.binary())], ["bucket", "sums", "score"])

    return dealt_out.repartitionById(n, F.col("bucket")).mapInArrow(run, "bucket int, sums binary, score binary")


def word_tree_sums(rows: DataFrame, *, depth: int = 3, gain: float = 20.0) -> tuple[DataFrame, int]:
    """Sums over all rows of each key of ``rows(key, text, train)``: key, n, known, base, score (log10); and the number of training tokens.

    The tree is that of all words: a context is any sequence of up to ``depth`` tokens, and all of its counts are kept. It predicts from its own counts if these are distributed otherwise than after the context that is one token shorter (count times Kullback-Leibler divergence of ``gain`` nats at least): a token's share is its count, and as many more as the context has distinct tokens after it, shared as after the longest kept shorter context, over their sum (Witten-Bell). The root has the tokens' shares less a discount (Good and Turing, n1 / (n1 + 2 n2)), which goes to the unknown token.

    Words get numbers and counts from buckets of words (exact, no hashes stand for them). Then each token is dealt out, with the tokens before it, by the word before it, so a bucket holds all that follows a context and works its shares out alone; only sums by text come back. No table is sent to all tasks.
    """
    n = partitions(rows)
    batches = checkpoint(encoded(rows, n))
    numbers = checkpoint(numbered_words(batches, n))
    sums = numbers.where("batch is null").agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens", "types", "once", "twice"))).first()
    tokens, types, once, twice = (int(x) for x in sums)
    root = Root(tokens, types, min(0.9, max(0.1, once / max(once + 2 * twice, 1))))

    def total(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, scores = [], []
        for p in parts:
            sums += [x for x in p.column(1).to_pylist() if x is not None]
            scores += [x for x in p.column(2).to_pylist() if x is not None]
        whole, part = unpack_all(sums, _whole), unpack_all(scores, _part)
        doc, back = np.unique(whole["doc"], return_inverse=True)
        at = np.searchsorted(doc, part["doc"])  # a text with a score has the other sums too, in this bucket
        out = [np.bincount(back, whole[f], len(doc)) for f in ("n", "known", "base", "score")]
        yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(out[0].astype("i8")), pa.array(out[1].astype("i8")), pa.array(out[2]), pa.array(out[3] + np.bincount(at, part["score"], len(doc)))], ["key", "n", "known", "base", "score"])
        trim()

    parts = contextual(positions(batches, numbers, root, depth, gain, n), root, depth, gain, n)
    return parts.repartitionById(n, F.col("bucket")).mapInArrow(total, "key long, n long, known long, base double, score double"), tokens
