"""Compressed rows of numbers, dealt out by a key's bucket: what tasks hand on where a Spark row for each number would cost too much."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard

#: Stands for a null id, and counts as larger than all others.
NO_ID = np.iinfo("i8").max


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def bucket(keys: np.ndarray, n: int) -> np.ndarray:
    return (mix(keys.astype("u8")) >> np.uint64(20)) % np.uint64(n)


def pack(rows: np.ndarray) -> bytes:
    """A structured array, field by field, compressed. Unsigned 8-byte fields hold hashes of 48 bits and take 6 bytes."""
    parts = [len(rows).to_bytes(8, "little")]
    for f in rows.dtype.names:
        column = np.ascontiguousarray(rows[f])
        parts.append(column.view("u1").reshape(-1, 8)[:, :6].tobytes() if rows.dtype[f] == "<u8" else column.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(data: bytes, kind: np.dtype) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(data)
    out, at = np.empty(int.from_bytes(raw[:8], "little"), kind), 8
    for f in kind.names:
        if kind[f] == "<u8":
            column = np.zeros((len(out), 8), "u1")
            column[:, :6] = np.frombuffer(raw, "u1", 6 * len(out), at).reshape(-1, 6)
            out[f] = column.view("<u8")[:, 0]
            at += 6 * len(out)
        else:
            out[f] = np.frombuffer(raw, kind[f], len(out), at)
            at += kind[f].itemsize * len(out)
    return out


def unpack_all(parts: list[bytes], kind: np.dtype) -> np.ndarray:
    return np.concatenate([np.empty(0, kind), *(unpack(p, kind) for p in parts)])


def dealt(rows: np.ndarray, keys: np.ndarray, n: int) -> Iterator[tuple[int, bytes]]:
    """The rows packed by bucket of their keys, in their own order."""
    at = bucket(keys, n).astype("u4")
    order = np.argsort(at, kind="stable")
    ends = np.searchsorted(at[order], np.arange(n + 1))
    for k in np.flatnonzero(np.diff(ends)):
        yield int(k), pack(rows[order[ends[k] : ends[k + 1]]])


def ids_of(column: pa.Array) -> np.ndarray:
    return column.fill_null(int(NO_ID)).to_numpy(zero_copy_only=False).astype("i8")




def slices(batches: Iterator[pa.RecordBatch], most: int = 12 << 20) -> Iterator[pa.RecordBatch]:
    """The batches, cut into parts of about ``most`` bytes, so that what a task holds for one is bounded (but for a single text longer than that)."""
    for b in batches:
        rows = max(1, b.num_rows // max(1, -(-b.nbytes // most)))
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
