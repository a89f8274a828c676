"""Texts of Arrow batches as code-point arrays: word bounds and word hashes without a Python loop over words.

Hashes are 64-bit and mix after every step, so no algebra of a text's letters makes two words meet, as it does under polynomial
hashes; words of at most three characters never meet each other. Where two words may not be taken for one, strings are compared
(`bpe`, `decontaminate`) or 128-bit digests are used (`jaccard_join`).

A block holds whole rows of up to BLOCK_BYTES (a longer row is a block of its own), so memory is bounded by the longest text.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1_000_000
#: Words of more code points are hashed one by one, by BLAKE2b.
LONG = 63


@dataclass
class Block:
    """Rows first..first+len(offsets)-2 of a batch; cp: their code points; row i is cp[offsets[i]:offsets[i+1]]."""

    first: int
    cp: np.ndarray
    offsets: np.ndarray
    raw: bytes | None = None

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1

    def utf8(self) -> tuple[bytes, np.ndarray]:
        """The block as UTF-8, and where each code point begins in it (and the last one ends)."""
        raw = self.raw if self.raw is not None else self.cp.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8", "replace")
        return raw, np.append(np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80), len(raw))


def blocks(col: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Null texts count as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    if n == 0:
        return
    width = np.int64 if pa.types.is_large_string(col.type) else np.int32
    offs = np.frombuffer(col.buffers()[1], width)[col.offset : col.offset + n + 1].astype(np.int64)
    data = memoryview(col.buffers()[2]) if col.buffers()[2] is not None else memoryview(b"")
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
        to = min(to, n)
        raw = bytes(data[offs[at] : offs[to]])
        try:
            cp = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
            lead = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
            count = np.concatenate([[0], np.cumsum(lead)])
            offsets = count[offs[at : to + 1] - offs[at]]
        except UnicodeDecodeError:
            parts = [np.frombuffer(bytes(data[a:b]).decode("utf-8", "replace").encode("utf-32-le"), np.uint32) for a, b in zip(offs[at:to], offs[at + 1 : to + 1], strict=True)]
            cp, offsets = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            raw = None
        yield Block(at, cp, offsets.astype(np.int64), raw)
        at = to


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finish, so that low bits depend on all."""
    x = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fold(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of short ranges of 64-bit values (n-grams of words): one step for each place, over all ranges."""
    n = ends - starts
    out = mix(n.astype(np.uint64) + np.uint64(0xD6E8FEB86659FD93))
    for k in range(int(n.max()) if len(n) else 0):
        live = np.flatnonzero(n > k) if (n <= k).any() else slice(None)
        out[live] = mix(out[live] + values[starts[live] + k])
    return out


class Hasher:
    """Hashes of substrings of one code-point array, three code points of 21 bits a step."""

    def __init__(self, cp: np.ndarray):
        self.cp = cp
        wide = np.concatenate([cp, np.zeros(3, cp.dtype)]).astype(np.uint64)
        self.lanes = wide[: len(cp) + 1] | (wide[1 : len(cp) + 2] << np.uint64(21)) | (wide[2 : len(cp) + 3] << np.uint64(42))

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        starts, n = np.asarray(starts, np.int64), np.asarray(ends, np.int64) - starts
        out = np.zeros(len(starts), np.uint64)
        long = n > LONG
        live = np.flatnonzero(~long) if long.any() else np.arange(len(n))
        left, at = n[live], starts[live]
        keep = np.array([0, (1 << 21) - 1, (1 << 42) - 1, (1 << 63) - 1], np.uint64)  # by how many of a lane's code points count
        while len(live):
            out[live] = mix(out[live] ^ (self.lanes[at] & keep[np.minimum(left, 3)]))
            more = left > 3
            live, left, at = live[more], left[more] - 3, at[more] + 3
        with np.errstate(over="ignore"):
            out = mix(out + n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        for i in np.flatnonzero(long):
            word = self.cp[starts[i] : starts[i] + n[i]].astype("<u4").tobytes()
            out[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return out


def hash_words(found: list[str]) -> np.ndarray:
    cp = np.frombuffer("".join(found).encode("utf-32-le"), np.uint32)
    to = np.cumsum(np.array([len(w) for w in found], np.int64))
    return Hasher(cp).of(np.concatenate([[0], to[:-1]]), to) if found else np.zeros(0, np.uint64)


def hash_word(word: str) -> int:
    return int(hash_words([word])[0])


def _table(keep: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    return keep(np.arange(256, dtype=np.uint32))


#: The two word patterns of the contracts, as tests on code points.
NOT_SPACE = _table(lambda c: ~((c == 0x20) | ((c >= 9) & (c <= 13))))
ALNUM = _table(lambda c: ((c >= 0x30) & (c <= 0x39)) | ((c >= 0x61) & (c <= 0x7A)) | (c >= 0x80) | ((c >= 0x41) & (c <= 0x5A)))
LOWER = np.arange(256, dtype=np.uint32) + 32 * ((np.arange(256) >= 65) & (np.arange(256) <= 90)).astype(np.uint32)


def lower_ascii(cp: np.ndarray) -> np.ndarray:
    return cp + np.uint32(32) * ((cp >= 65) & (cp <= 90))


def words(block: Block, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of members within rows, and the row of each. Code points from 256 are members."""
    cp, offsets = block.cp, block.offsets
    if not len(cp):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = member[np.minimum(cp, 255)]
    edge = np.zeros(len(cp) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside[:-1]]) & ~edge[:-1]
    after = np.concatenate([inside[1:], [False]]) & ~edge[1:]
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenated ranges start..start+length-1."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.ones(total, np.int64)
    full = lengths > 0
    s, n = starts[full], lengths[full]
    first = np.concatenate([[0], np.cumsum(n)[:-1]])
    out[first] = s
    out[first[1:]] -= s[:-1] + n[:-1] - 1
    return np.cumsum(out)


def trim() -> None:
    """Give freed memory back, so that a worker that is kept for later tasks does not hold what this one needed."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def map_blocks(df, text: str, schema: str, fn: Callable[[Block, pa.RecordBatch], pa.RecordBatch | None], limit: int = BLOCK_BYTES):
    """mapInArrow over blocks of a text column; fn gets each block and the batch's rows of that block."""

    def run(batches):
        for batch in batches:
            for block in blocks(batch.column(text), limit):
                out = fn(block, batch.slice(block.first, block.rows))
                if out is not None and out.num_rows:
                    yield out
        trim()

    return df.mapInArrow(run, schema)
