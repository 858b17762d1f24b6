"""The most similar vectors of every vector.

Method: shifted space-filling curves. Vectors are projected at random to ``dims`` dimensions, shifted and ordered by
their Hilbert key, several times over. Each ordering is cut into key ranges of about ``range_rows`` vectors that are
shuffle partitions; in a range, windows of neighbours along several local Hilbert orderings are compared by one matrix
product a window, and the windows' results are merged and reranked by exact similarity. Local grids are ranks of the
range's own coordinates, so they are as fine in a tight group as elsewhere. A vector with more mates of ``floor`` than
windows can be trusted with (a quarter of one) is crowded, and crowded vectors are compared with each other exactly.

Plan: a vector travels as 16-bit integers with its norm (cosine error about 1e-5), equal vectors only once. The
ranges come from a bounded sample of keys (``sample``); every vector is indexed. Keys that fill whole ranges are
spread over them by hash, another one in each curve. Crowded vectors go in blocks of a third of a range, and pairs of
blocks are tasks; a pair is left out only if its centres are too far apart for any mate better than those found. Work
is linear in windows, and quadratic in the size of a crowded group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlode.llm.textkernel import U64, mix
from siftlode.runtime import cut, pieces


def hilbert_keys(grid: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of integer points (rows x dims, ``bits`` each, dims * bits <= 63), by Skilling's transform."""
    x = [c.astype(U64) for c in grid.T]
    dims = len(x)
    level = 1 << (bits - 1)
    while level > 1:
        q, low = U64(level), U64(level - 1)
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, U64(0), (x[0] ^ x[i]) & low)
            x[0] = x[0] ^ np.where(high, low, swap)
            if i:
                x[i] = x[i] ^ swap
        level >>= 1
    for i in range(1, dims):
        x[i] = x[i] ^ x[i - 1]
    flip = np.zeros(len(grid), U64)
    level = 1 << (bits - 1)
    while level > 1:
        flip ^= np.where((x[-1] & U64(level)) != 0, U64(level - 1), U64(0))
        level >>= 1
    key = np.zeros(len(grid), U64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << U64(1) | ((x[i] ^ flip) >> U64(b)) & U64(1)
    return key.astype(np.int64)


class Curve:
    """One shifted ordering: a random projection, its shift, and Hilbert keys of unit vectors."""

    def __init__(self, seed: int, width: int, dims: int, bits: int):
        rng = np.random.default_rng(seed)
        self.axes = np.linalg.qr(rng.standard_normal((width, dims)))[0].astype(np.float32) * np.sqrt(width, dtype=np.float32)
        self.shift = rng.uniform(-0.25, 0.25, dims).astype(np.float32)
        self.bits = bits

    def keys(self, unit: np.ndarray, ranks: bool = False) -> np.ndarray:
        if ranks:
            return hilbert_keys((np.argsort(np.argsort(unit @ self.axes, axis=0), axis=0) << self.bits) // len(unit), self.bits)
        place = np.clip((unit @ self.axes + self.shift + 3.25) / 6.5, 0, 1 - 1e-6)
        return hilbert_keys((place * (1 << self.bits)).astype(np.int64), self.bits)


def _unit(q: np.ndarray) -> np.ndarray:
    v = q.astype(np.float32)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int16).reshape(-1, width)


def quantised(vectors: DataFrame, id_col: str, vector_col: str, width: int) -> DataFrame:
    """(id, q): usable vectors as 16-bit integers scaled to the largest component.

    Left out are vectors that are null, all zero, of another length, or hold a null, NaN or infinite component.
    """

    def go(batches):
        for batch in batches:
            lists = batch.column(1)
            size = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
            good = np.flatnonzero(size == width)
            flat = lists.take(pa.array(good)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
            top = np.abs(flat).max(axis=1, initial=0)
            fine = np.isfinite(top) & (top > 0)
            q = np.rint(flat[fine] / top[fine, None] * 32767).astype("<i2")
            rows = [r.tobytes() for r in q]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(good[fine])), pa.array(rows, pa.binary())], ["id", "q"])

    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    return base.where("id is not null").mapInArrow(go, "id long, q binary")


def _routes(width: int, dims: int, bits: int, curves: int, bounds: list[np.ndarray]):
    def go(batches):
        made = [Curve(1000 + c, width, dims, bits) for c in range(curves)]
        for batch in batches:
            if not batch.num_rows:
                continue
            q = _matrix(batch.column(1), width)
            unit = _unit(q)
            ids = batch.column(0).to_numpy()
            base = 0
            for c, curve in enumerate(made):
                key = curve.keys(unit)
                lo, hi = np.searchsorted(bounds[c], key, "left"), np.searchsorted(bounds[c], key, "right")
                spread = (mix(mix(ids.view(U64)) + U64(c)) >> U64(1)).astype(np.int64)
                part = lo + spread % (hi - lo + 1)
                yield pa.RecordBatch.from_arrays([pa.array((base + part).astype(np.int32)), batch.column(0), batch.column(1)], ["part", "id", "q"])
                base += len(bounds[c]) + 1

    return go


def _least(score: np.ndarray, k: int, floor: float, error: float) -> np.ndarray:
    """Of each row, the score below which no mate can be among the k best or reach ``floor``."""
    kth = np.partition(score, score.shape[1] - k, axis=1)[:, -k] if score.shape[1] > k else np.full(len(score), floor)
    return np.maximum(kth, floor)[:, None] - error


def _best(ids, q, unit, curve_keys, window, k, floor) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (row, mate, similarity) of the k best mates in the windows of each ordering, at least ``floor``, and which rows are crowded."""
    n, near = len(ids), []
    crowded = np.zeros(n, bool)
    block = max(128, window)
    for keys in curve_keys:
        order = np.argsort(keys, kind="stable")
        u = unit[order]
        for s in range(0, n, block):
            e, lo, hi = min(s + block, n), max(0, s - window), min(n, s + block + window)
            score = u[s:e] @ u[lo:hi].T
            score[np.arange(e - s), np.arange(s - lo, e - lo)] = -2
            many = (score >= floor).sum(axis=1)
            crowded[order[s:e]] |= many >= max(k, window // 4)
            i, j = np.nonzero(score >= (_least(score, k, floor, 1e-5) if (many > 8 * k).any() else floor - 1e-4))
            near.append(order[i + s] * n + order[j + lo])
    code = np.unique(np.concatenate(near)) if near else np.empty(0, np.int64)
    i, j = code // max(n, 1), code % max(n, 1)
    return *_ranked(ids, q, i, j, k, floor), crowded


def _ranked(ids, q, i, j, k, floor) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each row among distinct pairs (row, mate), by exact similarity, at least ``floor``."""
    n = len(ids)
    exact = np.empty(len(i))
    norm = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
    for s in range(0, len(i), 100_000):
        a, b = i[s : s + 100_000], j[s : s + 100_000]
        exact[s : s + 100_000] = np.einsum("ij,ij->i", q[a].astype(np.float64), q[b].astype(np.float64)) / (norm[a] * norm[b])
    keep = exact >= floor
    i, j, exact = i[keep], j[keep], exact[keep]
    order = np.lexsort((ids[j], -exact, i))
    i, j, exact = i[order], j[order], exact[order]
    first = np.searchsorted(i, np.arange(n))
    rank = np.arange(len(i)) - first[i]
    keep = rank < k
    return i[keep], j[keep], exact[keep]


def _range(width, dims, bits, local, window, k, floor):
    def go(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        ids = rows.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, q = ids[order], _matrix(rows.column("q"), width)[order]
        unit = _unit(q)
        part = int(key[0].as_py())
        curves = [Curve(7919 * part + 13 * c + 5, width, dims, bits) for c in range(local)]
        i, j, score, crowded = _best(ids, q, unit, (c.keys(unit, True) for c in curves), window, k, floor)
        return _lists(ids, i, j, score, crowded)

    return go


_MATES = "id long, mates array<struct<score:double,mate:long>>, crowded boolean"


def _lists(ids, i, j, score, crowded) -> pa.Table:
    """Ranked pairs as one row an id, in the form of ``_MATES``."""
    off = np.searchsorted(i, np.arange(len(ids) + 1))
    has = np.flatnonzero(np.diff(off))
    lists = np.concatenate([off[has], off[-1:]])
    mates = pa.StructArray.from_arrays([pa.array(score), pa.array(ids[j])], ["score", "mate"])
    return pa.table({"id": pa.array(ids[has]), "mates": pa.ListArray.from_arrays(pa.array(lists, pa.int32()), mates), "crowded": pa.array(crowded[has])})


def _among_crowded(rows: DataFrame, width: int, dims: int, bits: int, k: int, floor: float, block_rows: int, sample: int) -> DataFrame:
    """In the form of ``_MATES``: the k best mates of crowded vectors (id, q, worst) among themselves, block against block.

    ``worst`` is the k-th best similarity found so far; a pair of blocks that cannot better it for any row is left out.
    """
    n = rows.count()
    blocks = pieces(n, block_rows)
    drawn = rows.select("q").sample(min(1.0, sample / max(n, 1)), seed=12).limit(2 * sample).toPandas()
    keys = np.sort(Curve(1000, width, dims, bits).keys(_unit(np.frombuffer(b"".join(map(bytes, drawn["q"])), np.int16).reshape(-1, width)))) if len(drawn) else np.empty(0, np.int64)
    bounds = keys[(np.arange(1, blocks) * len(keys)) // blocks] if len(keys) else keys
    routed = cut(rows.select("id", "q").mapInArrow(_routes(width, dims, bits, 1, [bounds]), "part int, id long, q binary").join(rows.select("id", "worst"), "id"), "crowded")

    def extent(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        u = _unit(_matrix(part.column("q"), width))
        centre = u.mean(axis=0)
        centre /= max(float(np.linalg.norm(centre)), 1e-12)
        radius = float(np.arccos(np.clip(u @ centre, -1, 1)).max())
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "centre": pa.array([centre.tolist()], pa.list_(pa.float64())), "radius": pa.array([radius]), "worst": pa.array([min(part.column("worst").to_pylist())])})

    found = routed.groupBy("part").applyInArrow(extent, "part int, centre array<double>, radius double, worst double").collect()
    centre, radius = np.array([r["centre"] for r in found]), np.array([r["radius"] for r in found])
    reach = np.arccos(np.clip([r["worst"] for r in found], -1, 1))
    pairs = []
    for a in range(len(found)):
        gap = np.arccos(np.clip(centre[a:] @ centre[a], -1, 1)) - radius[a:] - radius[a] - 2e-3  # rounding of angles
        pairs += [(found[a]["part"], found[b]["part"]) for b in (a + np.flatnonzero((gap <= np.maximum(reach[a:], reach[a])) | (np.arange(len(gap)) == 0))).tolist()]
    ends = rows.sparkSession.createDataFrame([(p, f"{a} {b}") for a, b in pairs for p in {a, b}], "part int, pair string")

    def compare(key: tuple[pa.Scalar, ...], both: pa.Table) -> pa.Table:
        a, b = map(int, key[0].as_py().split())
        ids, part, q = both.column("id").to_numpy(), both.column("part").to_numpy(), _matrix(both.column("q"), width)
        unit = q / np.sqrt((q.astype(np.float64) ** 2).sum(axis=1, keepdims=True))
        rows_a, rows_b, near_i, near_j = np.flatnonzero(part == a), np.flatnonzero(part == b), [], []
        for one, other in ((rows_a, rows_b), (rows_b, rows_a))[: 1 if a == b else 2]:
            right = unit[other].T
            for s in range(0, len(one), 256):
                mine = one[s : s + 256]
                score = unit[mine] @ right
                score[mine[:, None] == other[None, :]] = -2
                i, j = np.nonzero(score >= _least(score, k, floor, 1e-12))
                near_i.append(mine[i])
                near_j.append(other[j])
        return _lists(ids, *_ranked(ids, q, np.concatenate(near_i), np.concatenate(near_j), k, floor), np.ones(len(ids), bool))

    return routed.select("part", "id", "q").join(F.broadcast(ends), "part").groupBy("pair").applyInArrow(compare, _MATES)


def nearest(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "vector", width: int = 64, k: int = 5, floor: float = 0.85, curves: int = 6, local: int = 4, window: int = 192, dims: int = 10, bits: int = 6, range_rows: int = 12_000, sample: int = 40_000) -> DataFrame:
    """(id, mate, similarity): the k most similar others of every vector, those of cosine ``floor`` or more.

    Ties go to the smaller id. Unusable vectors take no part (see ``quantised``); repeated rows count once; copies of
    one vector are each other's best mates, the smallest ids first. Only the two named columns are read.
    """
    spark = vectors.sparkSession
    base = cut(quantised(vectors, id_col, vector_col, width), "vectors")
    classes = cut(base.groupBy("q").agg(F.min("id").alias("id"), F.max("id").alias("last")), "classes")
    n = classes.count()
    ranges = pieces(n, range_rows)
    drawn = classes.select("q").sample(min(1.0, sample / max(n, 1)), seed=11).limit(2 * sample).toPandas()
    bounds = []
    for c in range(curves):
        if ranges == 1 or not len(drawn):
            bounds.append(np.empty(0, np.int64))
            continue
        keys = np.sort(Curve(1000 + c, width, dims, bits).keys(_unit(np.frombuffer(b"".join(map(bytes, drawn["q"])), np.int16).reshape(-1, width))))
        bounds.append(keys[(np.arange(1, ranges) * len(keys)) // ranges])
    routed = classes.select("id", "q").mapInArrow(_routes(width, dims, bits, curves, bounds), "part int, id long, q binary")
    found = cut(routed.groupBy("part").applyInArrow(_range(width, dims, bits, local, window, k, floor), _MATES), "mates")
    crowded = found.where("crowded").groupBy("id").agg(F.max(F.when(F.size("mates") >= k, F.element_at("mates", k)["score"]).otherwise(floor)).alias("worst"))
    if not crowded.isEmpty():
        rows = cut(classes.select("id", "q").join(crowded, "id"), "crowded-rows")
        found = found.unionByName(_among_crowded(rows, width, dims, bits, k, floor, max(1, range_rows // 3), sample))
    merged = found.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("mates"))).alias("mates"))
    best = merged.select("id", F.slice(F.array_sort("mates", lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).when(a["mate"] < b["mate"], -1).otherwise(1)), 1, k).alias("mates"))
    pairs = best.select("id", F.explode("mates").alias("m")).select("id", F.col("m.mate").alias("mate"), F.col("m.score").alias("similarity"))
    copies = base.join(classes.where("last > id").select("q", F.col("id").alias("rep")), "q").select("id", "rep").distinct()
    return _with_copies(pairs, copies, k)


def _with_copies(pairs: DataFrame, copies: DataFrame, k: int) -> DataFrame:
    """Carry results on representatives over to all copies; (id, rep) names the members of classes of several."""
    from pyspark.sql import Window

    copies = cut(copies, "copies")
    w = Window.partitionBy("rep").orderBy("id")
    heads = copies.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1).select("rep", F.col("id").alias("head"))
    own = copies.join(heads, "rep").where("id <> head").select("id", F.col("head").alias("mate"), F.lit(1.0).alias("similarity"))
    mates = pairs.join(heads.withColumnRenamed("rep", "mate"), "mate", "left").select("id", F.coalesce("head", "mate").alias("mate"), "similarity")
    spread = mates.join(copies.select(F.col("id").alias("copy"), F.col("rep").alias("id")), "id", "left").select(F.coalesce("copy", "id").alias("id"), "mate", "similarity")
    every = spread.unionByName(own)
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), "mate"))
    return every.withColumn("r", rank).where(F.col("r") <= k).select("id", "mate", "similarity")


def similar_pairs(vectors: DataFrame, id_col: str = "vec_id", **how) -> DataFrame:
    """(id_a, id_b): pairs in which at least one is among the other's k most similar, id_a < id_b."""
    near = nearest(vectors, id_col, **how)
    return near.select(F.least("id", "mate").alias(f"{id_col}_a"), F.greatest("id", "mate").alias(f"{id_col}_b")).distinct()
