"""Wavelet matrix shards of token ids.

One file holds the ids of some documents: for each bit, from the highest, the
bit-plane of the ids in the order that stable partitions by the bits above leave
them in, each plane packed and compressed, with a directory of ones up to every
block of bits. From the one file: access(i), rank(token, i), count(token),
select(token, k), ids(doc) and decode() of everything.

Layout: magic, length of a JSON header (uint32, little-endian), the header
(n, levels, zeros of each level, [offset, length] of each section), then the
zstd sections: doc ids and their null flags, token offsets of the documents,
planes, directories.
"""

from __future__ import annotations

import json
import struct
from functools import cached_property

import numpy as np
import zstandard

MAGIC, BLOCK = b"NFWM0001", 512


def _pack(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(a.tobytes())


def encode(ids: np.ndarray, doc_ids: list, ends: np.ndarray) -> bytes:
    """ids of all documents in a row; ends[i]: number of ids up to and with
    document i; doc_ids may hold None."""
    n = len(ids)
    levels = max(1, int(ids.max()).bit_length()) if n else 1
    a = ids.astype(np.uint16 if levels <= 16 else np.uint32)
    sections = [_pack(np.array([d or 0 for d in doc_ids], "<i8")), _pack(np.array([d is None for d in doc_ids], "u1")), _pack(np.asarray(ends, "<i8"))]
    zeros, planes, ranks = [], [], []
    for level in range(levels - 1, -1, -1):
        bit = (a & a.dtype.type(1 << level)).astype(bool)
        packed = np.packbits(bit, bitorder="little")
        padded = np.zeros(-(-n // BLOCK) * BLOCK // 8, np.uint8)
        padded[: len(packed)] = packed
        ones = np.bitwise_count(padded.reshape(-1, BLOCK // 8)).sum(axis=1, dtype=np.int64)
        ranks.append(_pack(np.concatenate([[0], np.cumsum(ones)]).astype("<i8")))
        planes.append(_pack(packed))
        zeros.append(n - int(np.count_nonzero(bit)))
        after = np.empty_like(a)  # compress() is much quicker than a mask where bits look random
        np.compress(bit, a, out=after[zeros[-1] :])
        np.compress(np.logical_not(bit, out=bit), a, out=after[: zeros[-1]])
        a = after
    sections += planes + ranks
    places, at = [], 0
    for s in sections:
        places.append([at, len(s)])
        at += len(s)
    header = json.dumps({"n": n, "docs": len(doc_ids), "levels": levels, "zeros": zeros, "sections": places}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(header)), header, *sections])


class Shard:
    """Reads one file; sections are unpacked when first asked for."""

    def __init__(self, data: bytes):
        if data[: len(MAGIC)] != MAGIC:
            raise ValueError("not a wavelet matrix shard")
        (length,) = struct.unpack_from("<I", data, len(MAGIC))
        self.base = len(MAGIC) + 4 + length
        self.header = json.loads(data[len(MAGIC) + 4 : self.base])
        self.data, self.n, self.levels, self.zeros = data, self.header["n"], self.header["levels"], self.header["zeros"]

    def _section(self, i: int, kind: str) -> np.ndarray:
        at, length = self.header["sections"][i]
        return np.frombuffer(zstandard.ZstdDecompressor().decompress(self.data[self.base + at : self.base + at + length], max_output_size=max(1, 8 * (self.n + self.header["docs"] + 2))), kind)

    @cached_property
    def doc_ids(self) -> list:
        return [None if null else int(d) for d, null in zip(self._section(0, "<i8"), self._section(1, "u1"), strict=True)]

    @cached_property
    def ends(self) -> np.ndarray:
        return self._section(2, "<i8")

    def plane(self, k: int) -> np.ndarray:
        return self._section(3 + k, np.uint8)

    @cached_property
    def _planes(self) -> list[np.ndarray]:
        return [self.plane(k) for k in range(self.levels)]

    @cached_property
    def _ranks(self) -> list[np.ndarray]:
        return [self._section(3 + self.levels + k, "<i8") for k in range(self.levels)]

    def _ones(self, k: int, i: int) -> int:
        """Ones among the first i bits of plane k."""
        block = i // BLOCK
        part = self._planes[k][block * BLOCK // 8 : -(-i // 8)]
        bits = np.unpackbits(part, bitorder="little")[: i - block * BLOCK]
        return int(self._ranks[k][block]) + int(bits.sum())

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k in range(self.levels):
            bit = self._planes[k][i // 8] >> (i % 8) & 1
            ones = self._ones(k, i)
            i = self.zeros[k] + ones if bit else i - ones
            value = value << 1 | int(bit)
        return value

    def _range(self, token: int, i: int) -> tuple[int, int]:
        """Where the token's occurrences among the first i ids are after all levels."""
        if token < 0 or token >> self.levels:
            return 0, 0
        lo, hi = 0, i
        for k in range(self.levels):
            lo_1, hi_1 = self._ones(k, lo), self._ones(k, hi)
            lo, hi = (self.zeros[k] + lo_1, self.zeros[k] + hi_1) if token >> (self.levels - 1 - k) & 1 else (lo - lo_1, hi - hi_1)
        return lo, hi

    def rank(self, token: int, i: int) -> int:
        """Occurrences of token among the first i ids."""
        lo, hi = self._range(token, i)
        return hi - lo

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def _nth(self, k: int, one: int, j: int) -> int:
        """Position of bit j (from 0) among the ones, or zeros, of plane k."""
        ones = self._ranks[k]
        upto = ones if one else np.minimum(np.arange(len(ones)) * BLOCK, self.n) - ones
        block = int(np.searchsorted(upto, j, "right")) - 1
        bits = np.unpackbits(self._planes[k][block * BLOCK // 8 : (block + 1) * BLOCK // 8], bitorder="little")
        return block * BLOCK + int(np.flatnonzero(bits == one)[j - int(upto[block])])

    def select(self, token: int, k: int) -> int:
        """Position of occurrence k (from 0) of token: its place after the last
        level, led back through the planes."""
        lo, hi = self._range(token, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        at = lo + k
        for level in range(self.levels - 1, -1, -1):
            one = token >> (self.levels - 1 - level) & 1
            at = self._nth(level, one, at - self.zeros[level] if one else at)
        return at

    def decode(self) -> np.ndarray:
        """All ids, by undoing the partitions from the last level up."""
        a = np.zeros(self.n, np.uint16 if self.levels <= 16 else np.uint32)
        for k in range(self.levels - 1, -1, -1):
            bit = np.unpackbits(self.plane(k), count=self.n, bitorder="little").view(bool)
            before = np.empty_like(a)
            before[np.flatnonzero(bit)] = a[self.zeros[k] :] | a.dtype.type(1 << (self.levels - 1 - k))
            before[np.flatnonzero(np.logical_not(bit, out=bit))] = a[: self.zeros[k]]
            a = before
        return a.astype("<u4")

    def ids(self, doc: int) -> np.ndarray:
        """The ids of document number `doc` of this file."""
        start = int(self.ends[doc - 1]) if doc else 0
        return np.array([self.access(i) for i in range(start, int(self.ends[doc]))], "<u4")
