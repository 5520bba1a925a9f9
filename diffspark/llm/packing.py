"""Packing tokenised documents into sequences of one length by minimum bin slack."""

from __future__ import annotations

import itertools
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from diffspark.llm._common import checkpoint, trim
from diffspark.llm._packed import slices

CAPACITY = 4096
#: Pieces that one task numbers together; salts are as many as that needs.
GROUP = 20_000
#: Entries of a worker's memo of encoded chunks and pieces; it is emptied when full, and at the end of a task, as workers go on to other stages. That changes no result.
MEMO = 250_000
#: Bytes of text that a task encodes at a time.
TEXT = 4 << 20

_encoders: dict[tuple[str, bool], "Encoder"] = {}


def byte_characters() -> dict[int, str]:
    """How byte-level tokenizers write a byte as a character: printable Latin-1 ones stand for themselves, the others, in order, for the characters from 256 on."""
    direct = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [x for x in range(256) if x not in direct]
    return {x: chr(256 + k) for k, x in enumerate(others)}


class Encoder(dict):
    """Ids of the chunks between a text's white space, by a tokenizers file; each chunk is encoded once and kept.

    White space must separate the tokenizer's tokens, so that a text's ids are those of its chunks in turn. ``by_pieces`` says that its normaliser is NFC and lower-casing and its pre-tokenizer splits by apostrophe endings, runs of letters, single numerals and runs of anything else, and writes bytes as characters: chunks of printable Latin-1 characters, which NFC leaves alone, are then put together from such pieces, and the model is asked for a piece directly.
    """

    PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\sa-z0-9ªµºß-öø-ÿ²³¹¼½¾]+|\n")
    PLAIN = re.compile(r"[!-~\xa1-\xff]+")
    BREAK = np.array([0xFFFFFFFF], "<u4").tobytes()
    BYTES = byte_characters()

    def __init__(self, path: str, by_pieces: bool):
        super().__init__()
        self.tokenizer, self.by_pieces, self.pieces = Tokenizer.from_file(path), by_pieces, {"\n": self.BREAK}

    def forget(self) -> None:
        self.clear()
        self.pieces = {"\n": self.BREAK}

    def raw(self, chunk: str) -> bytes:
        return np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()

    def plain(self, chunk: str) -> bool:
        return self.by_pieces and chunk != "" and "<|" not in chunk and (chunk.isascii() and chunk.isprintable() or self.PLAIN.fullmatch(chunk) is not None)

    def learn(self, chunks: list[str]) -> None:
        """Encode new chunks, all at once: their pieces lie in one text with line feeds between the chunks, and ids that no token has mark these."""
        own = [c for c in chunks if self.plain(c)]
        for c in set(chunks).difference(own) if len(own) < len(chunks) else ():
            self[c] = self.raw(c)
        if not own:
            return
        parts = self.PIECES.findall("\n".join(own).lower())
        pieces, tokenize = self.pieces, self.tokenizer.model.tokenize
        for p in set(parts).difference(pieces):
            pieces[p] = array("I", [t.id for t in tokenize(p if p.isascii() else p.encode().decode("latin-1").translate(self.BYTES))]).tobytes()
        ids = b"".join(map(pieces.__getitem__, parts))
        ends = [*(4 * np.flatnonzero(np.frombuffer(ids, "<u4") == 0xFFFFFFFF)).tolist(), len(ids)]
        self.update(zip(own, map(ids.__getitem__, map(slice, [0, *(e + 4 for e in ends[:-1])], ends)), strict=True))

    def batch(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text (string, no nulls) as little-endian unsigned 32-bit integers. Chunks are cut and numbered by Arrow, so that Python sees each only once for a batch."""
        if len(self) + len(self.pieces) > MEMO:
            self.forget()
        cut = pc.ascii_split_whitespace(texts)
        coded = cut.flatten().dictionary_encode()
        own = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = list(map(self.get, own))
        if new := [k for k, x in enumerate(known) if x is None]:
            self.learn([own[k] for k in new])
            for k in new:
                known[k] = self[own[k]]
        size = np.fromiter(map(len, known), "i8", len(known)) // 4
        begin, pool = np.cumsum(size) - size, np.frombuffer(b"".join(known), "<u4")
        at = coded.indices.to_numpy()
        each = size[at]
        ends = np.concatenate([[0], np.cumsum(each)])
        ids = pool[np.repeat(begin[at] - ends[:-1], each) + np.arange(ends[-1])]
        bounds = ends[np.concatenate([[0], np.cumsum(pc.list_value_length(cut).to_numpy(zero_copy_only=False).astype("i8"))])].tolist()
        return (ids[a:z].tobytes() for a, z in itertools.pairwise(bounds))


def encoder(path: str, by_pieces: bool) -> Encoder:
    """One for each Python worker, which serves many tasks."""
    if (path, by_pieces) not in _encoders:
        _encoders[path, by_pieces] = Encoder(path, by_pieces)
    return _encoders[path, by_pieces]


def tokenize(docs: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text", end: int = 2, by_pieces: bool = True, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` ids of each document (its text's ids, then ``end``), cut from the front: doc_id, start, length, ids_crc32, doc_tokens, and with ``with_ids`` ids (array of int)."""
    names = ["start", "length", "ids_crc32", "doc_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, by_pieces)
        last = np.array([end], "<u4").tobytes()
        for batch in slices(batches, TEXT):
            row, cols, ids = [], [[], [], [], []], []
            for i, data in enumerate(encode.batch(batch.column(1).fill_null(""))):
                data += last
                for at in range(0, len(data), 4 * capacity):
                    part = data[at : at + 4 * capacity]
                    row.append(i)
                    for c, v in zip(cols, (at // 4, len(part) // 4, zlib.crc32(part), len(data) // 4), strict=True):
                        c.append(v)
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4").astype("i4"))
            out = [batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(c, pa.int64()) for c in cols)]
            yield pa.RecordBatch.from_arrays(out + ([pa.array(ids, pa.list_(pa.int32()))] if with_ids else []), ["doc_id", *names, *(["ids"] if with_ids else [])])
        encode.forget()
        trim()

    kind = dict(docs.select(F.col(doc_id).alias("doc_id")).dtypes)["doc_id"]
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in names) + (", ids array<int>" if with_ids else ""))


def best_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths, within ``counts``, whose sum comes nearest to ``room`` from below: length -> how many.

    Subset-sum over bit sets: bit s of ``reach`` says that s can be filled. Lengths come in from the longest down, each with its count cut into powers of two, until ``room`` itself can be reached; the steps are then followed back.
    """
    reach, steps, full = 1, [], (1 << (room + 1)) - 1
    for length in sorted(counts, reverse=True):
        left = min(counts[length], room // length)
        take = 1
        while left:
            take = min(take, left)
            wider = (reach | reach << (length * take)) & full
            if wider != reach:
                steps.append((reach, length, take))
                reach = wider
            left -= take
            take *= 2
        if reach >> room & 1:
            break
    at, out = reach.bit_length() - 1, {}
    for before, length, take in reversed(steps):
        if not before >> at & 1:
            at -= length * take
            out[length] = out.get(length, 0) + take
    return out


def plan_windows(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Minimum bin slack over a histogram of lengths: rows (length, first rank, ranks, copies, first sequence, offset).

    Each window starts with the longest length that remains and is filled by ``best_fill`` from the rest; a filling is repeated as often as the counts allow. The pieces of a length with ranks from ``first rank`` on lie ``copies`` to a sequence, one after another from ``offset``.
    """
    counts, used, rows, sequence = {k: v for k, v in counts.items() if v}, dict.fromkeys(counts, 0), [], 0
    while counts:
        longest = max(counts)
        rest = counts | {longest: counts[longest] - 1}
        fill = best_fill({k: v for k, v in rest.items() if v}, capacity - longest)
        fill[longest] = fill.get(longest, 0) + 1
        times = min(counts[k] // n for k, n in fill.items())
        offset = 0
        for length, n in sorted(fill.items(), reverse=True):
            rows.append((length, used[length], n * times, n, sequence, offset))
            used[length] += n * times
            counts[length] -= n * times
            offset += n * length
            if not counts[length]:
                del counts[length]
        sequence += times
    return rows


def pack(docs: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text", end: int = 2, by_pieces: bool = True, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` ids with little padding.

    A document longer than ``capacity`` is cut into full pieces and a rest. Only a histogram of piece lengths, of at most ``capacity`` rows, reaches the driver, where minimum bin slack plans the windows; a piece then finds its place from its rank among the pieces of its length. Ranks are numbered in salted groups of about 20,000 pieces (a length may hold a third of all), whose counts are summed before.

    Returns for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id (gapless from 0), offset, and with ``with_ids`` ids.

    Defined cases: a null or empty text is the end id alone; equal pieces and repeated rows are packed each; null ids are ids like others; an empty table gives an empty table; columns other than id and text are not read.
    """
    pieces = checkpoint(tokenize(docs, path, doc_id=doc_id, text=text, end=end, by_pieces=by_pieces, capacity=capacity, with_ids=with_ids))
    salts = max(1, -(-pieces.count() // GROUP))
    pieces = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)))
    groups = pieces.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    histogram = {r["length"]: r["n"] for r in groups.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    plan = np.array(sorted(plan_windows(histogram, capacity)), "i8").reshape(-1, 6)
    before = W.partitionBy("length").orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)
    groups = groups.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = W.partitionBy("length", "_salt").orderBy("doc_id", "start", "ids_crc32")
    ranked = pieces.join(groups, ["length", "_salt"]).withColumn("_rank", F.col("_before") + F.row_number().over(inside) - 1)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else [])]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = plan[:, 0] << 44 | plan[:, 1]
        for batch in batches:
            rank, length = batch.column("_rank").to_numpy(), batch.column("length").to_numpy()
            row = plan[np.searchsorted(first, length << 44 | rank, "right") - 1]
            at = rank - row[:, 1]
            sequence, offset = row[:, 4] + at // row[:, 3], row[:, 5] + at % row[:, 3] * length
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(sequence), pa.array(offset)], [*columns, "sequence_id", "offset"])

    kinds = dict(ranked.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in columns) + ", sequence_id long, offset long"
    return ranked.select(*columns, "_rank").mapInArrow(place, schema)
