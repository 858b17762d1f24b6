"""Near-duplicate records with small edits.

Method: a binary trie self-join. Every text becomes a bit string: one bit of each of 128 min-hash values of its word
runs, so that texts of similarity s differ in about (1 - s) / 2 of the bits. A trie over the bit strings is joined
with itself: node pairs are traversed together, differing bits accumulate, and a pair is pruned once they exceed the
Hamming error budget. The budget is one for the whole string and smaller ones for its beginnings (``prefix_budgets``),
so that node pairs and whole blocks go as early as the bits allow. Pairs that survive are checked exactly.

The trie is a forest: its top levels are whole min-hash values (two a tree, ``trees`` trees) with an error budget of
zero, so each subtree below them is a shuffle key; the budget is spent in the levels below. With 28 trees a pair of
similarity 0.6 is missed with probability 4e-6, and the budget of 47 bits loses 2e-6 of such pairs. A subtree of more
than ``block`` classes mostly holds texts that share a few runs (a licence, an import list) and are not similar, which
no budget can tell apart within the few levels that a trie of so many rows has. Its texts descend into a second forest
of other values, three a tree and ``_DEEP`` trees (missed again with probability 4e-6), whose keys such texts seldom
share; only what is still crowded there is joined block against block.

Plan: texts with equal sets of runs form a class, one row each, before anything else; classes meet in sorted
partitions that are streamed. Crowded keys are known from a bounded sample of classes before the shuffle and are taken
out of it; one that the sample missed is noticed while it streams and is passed on, not held. Blocks are trie nodes
(ranges of the bit strings) in tasks of bounded size. Contents are fetched only for texts that descend and for the
classes in surviving pairs.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlode.llm.textkernel import U64, mix, slices, word_hashes
from siftlode.runtime import cut, spread

BITS = 128
LEAF = 16
#: Trees of the second forest, and min-hash values a tree: 1 - 0.6 ** 3 to the power 51 is 4e-6.
_DEEP, _DEEP_VALUES = 51, 3


def _seeds(n: int, first: int = 0) -> np.ndarray:
    return mix(np.arange(first + 1, first + n + 1, dtype=U64)) | U64(1)


@functools.cache
def prefix_budgets(budget: int, threshold: float, miss: float = 1e-8) -> tuple[int, ...]:
    """Of each number of leading bits, how many may differ: a pair of the threshold has more with probability ``miss``.

    Each bit of such a pair differs with probability (1 - threshold) / 2; the budget of all bits bounds every beginning.
    """
    q = (1 - threshold) / 2
    allowed = []
    for n in range(BITS + 1):
        tail, k = 0.0, n
        while k >= 0:
            tail += math.comb(n, k) * q**k * (1 - q) ** (n - k)
            if tail > miss:
                break
            k -= 1
        allowed.append(min(budget, k))
    return tuple(allowed)


def run_sets(arr: pa.Array, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row the sorted distinct hashes of its runs of ``run`` words (flat, with offsets), and its number of words."""
    words, off = word_hashes(arr, False)
    count = np.diff(off)
    many = np.maximum(count - run + 1, 0)
    start = np.repeat(off[:-1] - (np.cumsum(many) - many), many) + np.arange(many.sum())
    code = np.zeros(len(start), U64)
    for k in range(run):
        code = mix(code * U64(3) + words[start + k])
    row = np.repeat(np.arange(len(count)), many)
    order = np.lexsort((code, row))
    code, row = code[order], row[order]
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != code[:-1]) | (row[1:] != row[:-1])
    code, row = code[keep], row[keep]
    return code, np.searchsorted(row, np.arange(len(count) + 1)), count


def _min_hashes(code: np.ndarray, first: np.ndarray, n: int, skip: int = 0) -> np.ndarray:
    """Rows x n min-hash values of non-empty sets that start at ``first``; ``skip`` is how many hash functions to pass over."""
    out = np.empty((len(first), n), np.uint32)
    for k, seed in enumerate(_seeds(n, skip)):
        h = code * seed
        out[:, k] = np.minimum.reduceat((h ^ (h >> U64(29))) * U64(0xBF58476D1CE4E5B9) >> U64(32), first)
    return out


def signatures(records: DataFrame, trees: int, run: int, min_words: int) -> DataFrame:
    """(id, class, s0, s1, keys): the class of equal run sets, the bit string and the tree keys of each long enough text."""

    def go(batches):
        for batch in batches:
            for at, part in slices(batch.column(1)):
                code, off, words = run_sets(part, run)
                keep = np.flatnonzero((words >= min_words) & (np.diff(off) > 0))
                if not len(keep):
                    continue
                live = np.repeat(np.isin(np.arange(len(words)), keep), np.diff(off))
                size = np.diff(off)[keep]
                code, first = code[live], np.cumsum(size) - size
                low = _min_hashes(code, first, BITS)
                bits = np.packbits((low & 1).astype(np.uint8), axis=1).view(">u8").astype(U64)
                pairs = low[:, : 2 * trees].astype(U64)
                key = mix((pairs[:, 0::2] << U64(32) | pairs[:, 1::2]) + mix(np.arange(trees, dtype=U64) + U64(7)))
                m = mix(code)
                c0 = np.add.reduceat(m, first)
                c1 = np.add.reduceat(mix(m ^ U64(0xA5A5A5A5A5A5A5A5)), first)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(keep + at)),
                        pa.array(c0.view(np.int64)),
                        pa.array(c1.view(np.int64)),
                        pa.array(bits[:, 0].copy().view(np.int64)),
                        pa.array(bits[:, 1].copy().view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(keep) + 1) * trees, pa.int32()), pa.array(key.ravel().view(np.int64))),
                    ],
                    ["id", "c0", "c1", "s0", "s1", "keys"],
                )

    return spread(records).mapInArrow(go, "id long, c0 long, c1 long, s0 long, s1 long, keys array<long>")


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a[:, 0] ^ b[:, 0]).astype(np.int16) + np.bitwise_count(a[:, 1] ^ b[:, 1])


def _bit(s: np.ndarray, depth: int) -> np.ndarray:
    return (s[:, depth >> 6] >> U64(63 - (depth & 63))) & U64(1)


def trie_pairs(s: np.ndarray, t: np.ndarray | None, allowed: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, int]:
    """Index pairs of rows within the budgets, and how many pairs were compared: of ``s`` with itself (i < j), or with ``t``.

    Both are sorted bit strings (rows of two 64-bit halves); a node is a range of rows that share a prefix, and
    ``allowed`` has the budget of each length of prefix. Levels that all rows of both nodes share are passed at once.
    """
    self_join = t is None
    t = s if self_join else t
    left, right, seen = [], [], 0
    stack = [(0, len(s), 0, len(t), 0, 0)]
    while stack:
        a, b, c, d, depth, diff = stack.pop()
        if a == b or c == d:
            continue
        if diff <= allowed[depth] and (b - a) * (d - c) > LEAF * LEAF:
            same_a, same_b = _shared(s[a], s[b - 1]), _shared(t[c], t[d - 1])
            upto = min(same_a, same_b)
            if upto > depth:  # both ranges are sorted: what their ends share, all share
                depth, diff = upto, _distance_upto(s[a], t[c], upto)
        if diff > allowed[depth]:
            continue
        if (b - a) * (d - c) <= LEAF * LEAF or depth == BITS:
            i, j = np.divmod(np.arange((b - a) * (d - c)), d - c)
            i, j = i + a, j + c
            if self_join and a == c:
                keep = i < j
                i, j = i[keep], j[keep]
            seen += len(i)
            near = _distance(s[i], t[j]) <= allowed[BITS]
            left.append(i[near])
            right.append(j[near])
            continue
        m = a + int(np.searchsorted(_bit(s[a:b], depth), 1))
        n = m if self_join and a == c else c + int(np.searchsorted(_bit(t[c:d], depth), 1))
        stack.append((a, m, c, n, depth + 1, diff))
        stack.append((m, b, n, d, depth + 1, diff))
        stack.append((a, m, n, d, depth + 1, diff + 1))
        if not (self_join and a == c):
            stack.append((m, b, c, n, depth + 1, diff + 1))
    empty = np.empty(0, np.int64)
    return (np.concatenate(left), np.concatenate(right), seen) if left else (empty, empty, seen)


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    """How many leading bits two rows share."""
    high, low = int(x[0]) ^ int(y[0]), int(x[1]) ^ int(y[1])
    return 64 - high.bit_length() if high else 128 - low.bit_length()


def _distance_upto(x: np.ndarray, y: np.ndarray, depth: int) -> int:
    both = ((int(x[0]) ^ int(y[0])) << 64 | int(x[1]) ^ int(y[1])) >> (BITS - depth)
    return both.bit_count()


def _run_pairs(s: np.ndarray, first: np.ndarray, size: np.ndarray, allowed: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs within the budget inside each run of rows; short runs together, by vector operations, as single leaves."""
    left, right = [], []
    for n in np.unique(size):
        at = first[size == n]
        if n <= 3 * LEAF:
            i, j = np.triu_indices(int(n), 1)
            step = max(1, 2_000_000 // len(i))
            for k in range(0, len(at), step):
                a, b = (at[k : k + step, None] + i).ravel(), (at[k : k + step, None] + j).ravel()
                near = _distance(s[a], s[b]) <= allowed[BITS]
                left.append(a[near])
                right.append(b[near])
        else:
            for k in at:
                a, b, _ = trie_pairs(s[k : k + n], None, allowed)
                left.append(a + k)
                right.append(b + k)
    empty = np.empty(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (empty, empty)


_JOINED = "a long, b long, tree long, s0 long, s1 long"


def _joined(ids, left, right) -> pa.RecordBatch:
    a, b = ids[left], ids[right]
    code = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1) if len(a) else np.empty((2, 0), np.int64)
    none = pa.nulls(code.shape[1], pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(code[0]), pa.array(code[1]), none, none, none], ["a", "b", "tree", "s0", "s1"])


def _stream(allowed: tuple[int, ...], block: int):
    """Join the runs of equal tree keys of a sorted partition. A run of more than ``block`` rows is passed on (b is null)."""

    def passed(ids, tree, s) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.nulls(len(ids), pa.int64()), pa.array(tree), pa.array(s[:, 0].copy().view(np.int64)), pa.array(s[:, 1].copy().view(np.int64))], ["a", "b", "tree", "s0", "s1"])

    def go(batches):
        kept, flowing = None, None
        for batch in batches:
            tree, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            s = np.stack([batch.column(2).to_numpy().view(U64), batch.column(3).to_numpy().view(U64)], axis=1)
            if kept is not None:
                tree, ids, s = np.concatenate([kept[0], tree]), np.concatenate([kept[1], ids]), np.concatenate([kept[2], s])
                kept = None
            if not len(tree):
                continue
            first = np.flatnonzero(np.concatenate([[True], tree[1:] != tree[:-1]]))
            size = np.diff(np.append(first, len(tree)))
            last = first[-1]
            if flowing is not None and tree[0] == flowing:
                yield passed(ids[: size[0]], tree[: size[0]], s[: size[0]])
                if len(first) == 1:
                    continue
                first, size = first[1:], size[1:]
            flowing = None
            if size[-1] > block:
                flowing = tree[-1]
                yield passed(ids[last:], tree[last:], s[last:])
            else:
                kept = (tree[last:], ids[last:], s[last:])
            first, size = first[:-1], size[:-1]
            for k in np.flatnonzero(size > block):
                r = slice(first[k], first[k] + size[k])
                yield passed(ids[r], tree[r], s[r])
            some = (size > 1) & (size <= block)
            if some.any():
                yield _joined(ids, *_run_pairs(s, first[some], size[some], allowed))
        if kept is not None and len(kept[0]) > 1:
            yield _joined(kept[1], *_run_pairs(kept[2], np.zeros(1, np.int64), np.array([len(kept[0])]), allowed))

    return go


def _blocks(allowed: tuple[int, ...]):
    def go(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        s = np.stack([rows.column(c).to_numpy().view(U64) for c in ("s0", "s1")], axis=1)
        ids, side = rows.column("a").to_numpy(), rows.column("side").to_numpy()
        order = np.lexsort((s[:, 1], s[:, 0], side))
        s, ids, side = s[order], ids[order], side[order]
        m = int(np.searchsorted(side, 1))
        if m == len(side):
            i, j, _ = trie_pairs(s, None, allowed)
        else:
            i, j, _ = trie_pairs(s[:m], s[m:], allowed)
            j = j + m
        return pa.Table.from_batches([_joined(ids, i, j).select(["a", "b"])])

    return go


def block_pairs(nodes: DataFrame, allowed: tuple[int, ...]) -> DataFrame:
    """(tree, node, mate): the pairs of blocks of a tree whose prefixes differ in no more bits than their length allows.

    ``nodes`` has (tree, depth, node): the ``depth`` leading bits that the rows of a block share.
    """
    other = nodes.select("tree", F.col("node").alias("mate"))
    limit = F.element_at(F.array(*[F.lit(k) for k in allowed]), F.col("depth") + 1)
    return nodes.join(other, "tree").where(F.col("node") <= F.col("mate")).where(F.bit_count(F.col("node").bitwiseXOR(F.col("mate"))) <= limit).select("tree", "node", "mate")


def _join_hot(hot: DataFrame, allowed: tuple[int, ...], block: int) -> DataFrame:
    """Pairs (a, b) inside subtrees too large to hold: block against block, each pair of blocks one task's group.

    Blocks are trie nodes: rows are cut by the leading bits, as many as bring the average under ``block``; of a node
    that stays larger, since its rows share those bits, the rows are dealt out over parts by their id.
    """
    sizes = hot.groupBy("tree").agg(F.count("*").alias("n"))
    depth = F.least(F.lit(31), F.ceil(F.log2(F.col("n") / F.lit(block))) + 1).cast("int")
    placed = hot.join(sizes.select("tree", depth.alias("depth")), "tree").withColumn("node", F.expr("int(shiftrightunsigned(s0, 64 - depth))"))
    counted = cut(placed.groupBy("tree", "depth", "node").agg(F.count("*").alias("n")), "nodes")
    parts = F.ceil(F.col("n") / F.lit(block)).cast("int")
    dealt = placed.join(counted.select("tree", "node", parts.alias("parts")), ["tree", "node"]).withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int"))
    each = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    near = block_pairs(counted, allowed).join(counted.select("tree", "node", parts.alias("parts")), ["tree", "node"])
    near = near.select("tree", "node", "mate", each.alias("part")).join(counted.select("tree", F.col("node").alias("mate"), parts.alias("parts")), ["tree", "mate"])
    near = near.select("tree", "node", "part", "mate", each.alias("mate_part")).where("node < mate or part <= mate_part")
    key = ["tree", "node", "part", "mate", "mate_part"]
    left = dealt.join(near, ["tree", "node", "part"]).select(*key, "a", "s0", "s1", F.lit(0).alias("side"))
    far = near.where("node < mate or part < mate_part").select("tree", F.col("node").alias("from"), F.col("part").alias("from_part"), F.col("mate").alias("node"), F.col("mate_part").alias("part"))
    right = dealt.join(far, ["tree", "node", "part"]).select("tree", F.col("from").alias("node"), F.col("from_part").alias("part"), F.col("node").alias("mate"), F.col("part").alias("mate_part"), "a", "s0", "s1", F.lit(1).alias("side"))
    return left.unionByName(right).groupBy(*key).applyInArrow(_blocks(allowed), "a long, b long")


def crowded_keys(signed: DataFrame, block: int, sample: int) -> DataFrame:
    """(tree): keys that hold more classes than ``block``, as a sample of about ``sample`` classes shows; all, in a smaller table.

    It only decides which way a row goes, never whether a pair is found; the list has at most trees * sample / 3 keys.
    """
    n = signed.count()
    share = min(1.0, sample / max(n, 1))
    h = F.xxhash64("c0", "c1")
    some = signed if share == 1 else signed.where(h < -(1 << 63) + int((1 << 64) * share))
    keys = some.groupBy("c0", "c1").agg(F.first("keys").alias("keys")).select(F.explode("keys").alias("tree"))
    return keys.groupBy("tree").agg(F.count("*").alias("n")).where(F.col("n") > max(3 if share < 1 else 0, block * share)).select("tree")


def deep_keys(records: DataFrame, run: int, trees: int = _DEEP) -> DataFrame:
    """(a, s0, s1, tree): the rows of the second forest for (id, text, s0, s1) records, ``trees`` a record."""

    def go(batches):
        for batch in batches:
            for at, part in slices(batch.column(1)):
                code, off, _ = run_sets(part, run)
                low = _min_hashes(code, off[:-1], trees * _DEEP_VALUES, BITS).astype(U64)
                key = np.zeros((len(part), trees), U64)
                for k in range(_DEEP_VALUES):
                    key = mix((key << U64(1)) + low[:, k::_DEEP_VALUES] + mix(np.arange(trees, dtype=U64) + U64(977)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(at, len(part)) for c in (0, 2, 3)), pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * trees, pa.int32()), pa.array(key.ravel().view(np.int64)))], ["a", "s0", "s1", "keys"])

    made = records.select("id", "text", "s0", "s1").mapInArrow(go, "a long, s0 long, s1 long, keys array<long>")
    return made.select(F.explode("keys").alias("tree"), "a", "s0", "s1")


def _streamed(rows: DataFrame, allowed: tuple[int, ...], block: int, tag: str) -> DataFrame:
    """Join the rows (tree, a, s0, s1) of each key; b is null for those of crowded keys, which are passed on."""
    return cut(rows.select("tree", "a", "s0", "s1").repartition("tree").sortWithinPartitions("tree").mapInArrow(_stream(allowed, block), _JOINED), tag)


def candidates(base: DataFrame, signed: DataFrame, reps: DataFrame, run: int, allowed: tuple[int, ...], block: int, sample: int) -> DataFrame:
    """(a, b) of classes within the budgets that share a key of the first forest, or in crowded places of the second."""
    crowd = cut(crowded_keys(signed, block, sample), "crowd")
    rows = reps.select(F.explode("keys").alias("tree"), F.col("rep").alias("a"), "s0", "s1")
    is_hot = not crowd.isEmpty()
    calm = rows.join(crowd, "tree", "left_anti") if is_hot else rows
    joined = _streamed(calm, allowed, block, "trie")
    found = joined.where("b is not null").select("a", "b")
    down = joined.where("b is null").select(F.col("a").alias("id"), "s0", "s1")
    if is_hot:
        down = down.unionByName(rows.join(crowd, "tree", "left_semi").select(F.col("a").alias("id"), "s0", "s1"))
    down = cut(down.distinct(), "descending")
    if down.isEmpty():
        return found.distinct()
    texts = base.join(down, "id").dropDuplicates(["id"])
    deep = _streamed(deep_keys(texts, run), allowed, block, "deep")
    found = found.unionByName(deep.where("b is not null").select("a", "b"))
    return found.unionByName(_join_hot(deep.where("b is null").select("tree", "a", "s0", "s1"), allowed, block)).distinct()


def near_classes(docs: DataFrame, id_col: str = "vec_id", text_col: str = "content", threshold: float = 0.6, run: int = 3, min_words: int = 20, trees: int = 28, budget: int = 47, block: int = 4000, sample: int = 20_000) -> tuple[DataFrame, DataFrame]:
    """(members, links): (id, rep) of every long enough text, and (rep_a, rep_b, similarity) of similar classes.

    Similarity is shared distinct runs of ``run`` words over all runs of both. Texts with the same runs share a class,
    named by its smallest id. Null and short texts (under ``min_words``) are in no class; repeated rows count once;
    ids must be integers; only the two named columns are read. ``sample`` bounds the classes from which crowded keys
    are known before the shuffle; all texts are joined whatever it shows.
    """
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    sigs = signatures(base, trees, run, min_words)
    signed = cut(sigs, "signatures")
    reps = signed.groupBy("c0", "c1").agg(F.min("id").alias("rep"), F.first("s0").alias("s0"), F.first("s1").alias("s1"), F.first("keys").alias("keys"))
    members = signed.select("id", "c0", "c1").join(reps.select("c0", "c1", "rep"), ["c0", "c1"]).select("id", "rep").distinct()
    cand = cut(candidates(base, signed, reps, run, prefix_budgets(budget, threshold), block, sample), "candidates")
    wanted = cand.select(F.explode(F.array("a", "b")).alias("id")).distinct()

    def sets(batches):
        for batch in batches:
            for at, part in slices(batch.column(1)):
                code, off, _ = run_sets(part, run)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(code.view(np.int64)))], ["id", "runs"])

    runs = base.join(wanted, "id", "left_semi").mapInArrow(sets, "id long, runs array<long>").dropDuplicates(["id"])
    both = cand.join(runs.select(F.col("id").alias("a"), F.col("runs").alias("ra")), "a").join(runs.select(F.col("id").alias("b"), F.col("runs").alias("rb")), "b")
    shared = F.size(F.array_intersect("ra", "rb"))
    scored = both.select(F.col("a").alias("rep_a"), F.col("b").alias("rep_b"), (shared / (F.size("ra") + F.size("rb") - shared)).alias("similarity"))
    return members, scored.where(F.col("similarity") >= threshold - 1e-12)


def near_pairs(docs: DataFrame, id_col: str = "vec_id", **how) -> DataFrame:
    """(id_a, id_b) of all pairs of similar records, id_a < id_b: within each class, and across linked classes."""
    members, links = near_classes(docs, id_col, **how)
    members = cut(members, "members")
    a = members.select(F.col("id").alias("x"), F.col("rep").alias("rep_a"))
    b = members.select(F.col("id").alias("y"), F.col("rep").alias("rep_b"))
    within = a.join(b, F.col("rep_a") == F.col("rep_b")).where("x < y").select("x", "y")
    across = links.join(a, "rep_a").join(b, "rep_b").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    return within.unionByName(across).select(F.col("x").alias(f"{id_col}_a"), F.col("y").alias(f"{id_col}_b"))
