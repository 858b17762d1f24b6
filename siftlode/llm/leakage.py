"""Evaluation texts leaking into training text.

Method: greedy string tiling with running Karp-Rabin. Windows of ``min_match`` words of every document are hashed by
prefix sums and joined with the windows of the evaluation items (shared-token seeds). For each document and item with
a seed, the longest common run of words that is not yet marked is marked in both, again and again, until none of
``min_match`` words is left. The tiles' share of the item is tested against a threshold, which catches passages whose
parts were reordered.

Plan: the items' window hashes are a table; a bit table of them, of at most 8 MB at any number of items, is broadcast,
and one map-only pass over the documents, however many items there are, gives the windows that may be among them as
short rows (document, hash, position). These are joined with the items' windows by hash and grouped by document and
item. No text is shuffled, and no item comes to the driver.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlode.llm import bittable
from siftlode.llm.textkernel import slices, windows_hash, word_hashes
from siftlode.runtime import cut, spread


def tile(seeds_a: np.ndarray, seeds_b: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling from seeds: (start in a, start in b, length) of non-overlapping common runs, longest first.

    A seed says that the ``min_match`` words from there on are the same in a and b; ties go to the first in a, then b.
    """
    order = np.lexsort((seeds_a, seeds_a - seeds_b))
    a, b = seeds_a[order], seeds_b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] - b[1:] != a[:-1] - b[:-1]) | (a[1:] != a[:-1] + 1)
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(a))) + min_match - 1
    heap = [(-int(n), int(a[i]), int(b[i])) for i, n in zip(first, length)]
    heapq.heapify(heap)
    lo_a, lo_b = int(a.min()), int(b.min())
    used_a = np.zeros(int(a.max()) - lo_a + int(length.max()) + 1, bool)
    used_b = np.zeros(int(b.max()) - lo_b + int(length.max()) + 1, bool)
    tiles = []
    while heap:
        n, i, j = heapq.heappop(heap)
        n = -n
        taken = used_a[i - lo_a : i - lo_a + n] | used_b[j - lo_b : j - lo_b + n]
        if not taken.any():
            used_a[i - lo_a : i - lo_a + n] = used_b[j - lo_b : j - lo_b + n] = True
            tiles.append((i, j, n))
            continue
        free = np.concatenate([[True], taken, [True]])
        stops = np.flatnonzero(free)
        for p, q in zip(stops[:-1], stops[1:]):
            if q - p - 1 >= min_match:
                heapq.heappush(heap, (-int(q - p - 1), i + int(p), j + int(p)))
    return tiles


def _starts(off: np.ndarray, size: int) -> np.ndarray:
    """Positions at which a window of ``size`` stays inside its row."""
    count = np.maximum(np.diff(off) - size + 1, 0)
    base = np.cumsum(count) - count
    return np.repeat(off[:-1] - base, count) + np.arange(count.sum())


def _windows(size: int, shared=None, bits: int = 0):
    """(rows of a key, version, text) -> (row, version, code, pos, words): windows of ``size`` words; with a bit table, those in it."""

    def run(batches):
        for batch in batches:
            for at, part in slices(batch.column(2)):
                values, off = word_hashes(part, True)
                start = _starts(off, size)
                if not len(start):
                    continue
                code = windows_hash(values, start, size)
                if shared is not None:
                    hit = bittable.members(shared.value, code, bits)
                    start, code = start[hit], code[hit]
                row = np.searchsorted(off, start, side="right") - 1
                rows = pa.array(row + at)
                cols = [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(code.view(np.int64)), pa.array((start - off[row]).astype(np.int32)), pa.array(np.diff(off)[row].astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, [batch.schema.names[0], "version", "code", "pos", "words"])

    return run


def _tiled(size: int):
    """(seeds) -> (tiles, longest, covered) of each pair."""

    def run(batches):
        for batch in batches:
            n = batch.num_columns - 1
            made = []
            for seeds in batch.column(n):
                a, b = (seeds.values.field(k).to_numpy() for k in ("a", "b"))
                tiles = tile(a, b, size)
                made.append((len(tiles), max(t[2] for t in tiles), sum(t[2] for t in tiles)))
            cols = [pa.array([m[k] for m in made], pa.int32()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *cols], [*batch.schema.names[:n], "tiles", "longest", "covered"])

    return run


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "item_text", min_match: int = 15, min_coverage: float = 0.0) -> DataFrame:
    """(doc, item, tiles, longest, covered, coverage): documents that hold runs of at least ``min_match`` words of an item.

    Words are maximal runs of letters and digits of any script, lower-cased. ``covered`` counts the item's words in
    tiles, ``coverage`` its share of the item's words; rows under ``min_coverage`` are left out. Null and empty texts
    and items shorter than ``min_match`` words match nothing; repeated rows count once, different texts under one id
    each for themselves; only the named columns are read.
    """
    corpus = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("version"), F.col(text_col).alias("text")).where("text is not null")
    tests = items.select(F.col(item_col).alias("item"), F.xxhash64(item_text_col).alias("version"), F.col(item_text_col).alias("text")).where("text is not null")
    kinds = {"doc": dict(corpus.dtypes)["doc"], "item": dict(tests.dtypes)["item"]}
    shape = lambda k: f"{k} {kinds[k]}, version long, code long, pos int, words int"
    wanted = cut(tests.mapInArrow(_windows(min_match), shape("item")).distinct(), "item-windows")
    bits = bittable.bits_for(wanted.count())
    shared = docs.sparkSession.sparkContext.broadcast(bittable.build(wanted, "code", bits))
    met = spread(corpus).mapInArrow(_windows(min_match, shared, bits), shape("doc")).select("doc", F.col("version").alias("doc_version"), "code", F.col("pos").alias("a"))
    seeds = met.join(wanted.select("item", F.col("version").alias("item_version"), "code", F.col("pos").alias("b"), "words"), "code")
    pairs = seeds.groupBy("doc", "doc_version", "item", "item_version").agg(F.max("words").alias("words"), F.collect_set(F.struct("a", "b")).alias("seeds"))
    schema = f"doc {kinds['doc']}, doc_version long, item {kinds['item']}, item_version long, words int, tiles int, longest int, covered int"
    made = pairs.mapInArrow(_tiled(min_match), schema).withColumn("coverage", F.col("covered") / F.col("words"))
    return made.where(F.col("coverage") >= min_coverage).select(F.col("doc").alias(id_col), F.col("item").alias(item_col), "tiles", "longest", "covered", "coverage").distinct()
