"""A bit table of 64-bit codes: a test of bounded size for "may be among them", put together on the executors.

A table has at most 2 ** ``MOST`` bits (8 MB) at any number of codes, so it may be broadcast. Codes that are in it
always pass; others pass the more often the fuller it is, and a join with the codes themselves decides.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlode.llm.textkernel import U64

MOST, PART = 26, 15


def slots(codes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each code in a table of 2 ** ``bits``."""
    h = codes * U64(0x9E3779B97F4A7C15)
    again = (h ^ h >> U64(29)) * U64(0xBF58476D1CE4E5B9)
    return (h >> U64(64 - bits)).astype(np.int64), (again >> U64(64 - bits)).astype(np.int64)


def bits_for(n: int) -> int:
    """The size, in bits of an index, for ``n`` codes: 1,024 bits a code while that fits, so that one in 260,000 others passes."""
    return min(MOST, max(PART, math.ceil(math.log2(1024 * max(1, n)))))


def build(codes: DataFrame, column: str, bits: int) -> bytes:
    """The table of all codes of a column, part by part; the driver gets its bits only."""
    part_bits = min(bits, PART)

    def split(batches):
        for batch in batches:
            slot = np.unique(np.concatenate(slots(batch.column(0).to_numpy().view(U64), bits)))
            yield pa.RecordBatch.from_arrays([pa.array((slot >> part_bits).astype(np.int32)), pa.array((slot & (1 << part_bits) - 1).astype(np.int32))], ["part", "bit"])

    def pack(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        flag = np.zeros(1 << part_bits, bool)
        flag[rows.column("bit").to_numpy()] = True
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(flag, bitorder="little").tobytes()], pa.binary())})

    table = np.zeros((1 << bits) // 8, np.uint8)
    size = (1 << part_bits) // 8
    for r in codes.select(F.col(column)).mapInArrow(split, "part int, bit int").distinct().groupBy("part").applyInArrow(pack, "part int, bits binary").collect():
        table[r["part"] * size : (r["part"] + 1) * size] = np.frombuffer(r["bits"], np.uint8)
    return table.tobytes()


def members(table: bytes, codes: np.ndarray, bits: int) -> np.ndarray:
    """Indexes of the codes both of whose bits are set."""
    flags = np.frombuffer(table, np.uint8)
    is_set = lambda slot: (flags[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)
    at = np.flatnonzero(is_set(slots(codes, bits)[0]))
    return at[is_set(slots(codes[at], bits)[1])]
