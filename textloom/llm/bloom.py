"""A Bloom filter of 64-bit hashes with a fixed size, so that it may be sent to every task whatever it holds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches

#: A fixed size: about 1 % of false candidates up to 3 million hashes; with more of them, more candidates are checked in vain.
BLOOM_BYTES, PROBES = 4 << 20, 4


class Bloom:
    """Of 64-bit hashes, with a fixed size, so that it may be sent to every task."""

    def __init__(self, data: bytes | None = None):
        self.bits = np.frombuffer(data, np.uint8).copy() if data else np.zeros(BLOOM_BYTES, np.uint8)

    @staticmethod
    def place(hashes: np.ndarray, probe: int) -> np.ndarray:
        h = hashes.astype(np.int64).view(np.uint64)
        return (((h & np.uint64(0xFFFFFFFF)) + np.uint64(probe) * ((h >> np.uint64(32)) | np.uint64(1))) % np.uint64(BLOOM_BYTES * 8)).astype(np.int64)

    def add(self, hashes: np.ndarray) -> None:
        for i in range(PROBES):
            p = self.place(hashes, i)
            np.bitwise_or.at(self.bits, p >> 3, (1 << (p & 7)).astype(np.uint8))

    def has(self, hashes: np.ndarray) -> np.ndarray:
        """Whether each may have been added; a probe looks only at those that passed the one before."""
        left = np.arange(len(hashes))
        for i in range(PROBES):
            p = self.place(hashes[left], i)
            left = left[(self.bits[p >> 3] >> (p & 7).astype(np.uint8) & 1).astype(bool)]
        out = np.zeros(len(hashes), bool)
        out[left] = True
        return out


def filter_of(hashes: DataFrame) -> bytes:
    """The Bloom filter of a column of hashes, built by tasks and joined on the driver: BLOOM_BYTES for each of at most 8 tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom, used = Bloom(), False
        for b in batches:
            bloom.add(b.column(0).to_numpy())
            used = used or len(b) > 0
        if used:
            yield pa.RecordBatch.from_arrays([pa.array([bloom.bits.tobytes()], pa.binary())], ["bits"])

    out = Bloom()
    for row in map_batches(hashes.coalesce(8), run, "bits binary").toLocalIterator():
        out.bits |= np.frombuffer(row[0], np.uint8)
    return out.bits.tobytes()
