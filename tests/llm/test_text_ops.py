"""Tokens, leaks and near-duplicates against brute force."""

import itertools
import os
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftlode.llm import leakage, neardup, textkernel, tokens

TEXTS = [None, "", " ", "  \n\t x", "It's we'll 'til '' 's\u00a0d", "<|endoftext|> a", "naïve 東京 ١٢ 12a_b", "e\u0301 \u200b zero", "a" * 5000, "  lead  two   spaces  ", "tabs\t\tand\r\nlines\n\n\n", "don'treally 'street'm", "😀😀 🇩🇪"]
CLASH = "doc_id long, text string, block string, word string, ids string, doc int"


def reference_encode(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(os.path.join(os.path.dirname(tokens.default_vocabulary()), "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def back_of(piece):
    with open(tokens.default_vocabulary(), "rb") as f:
        return {v: k for k, v in tokens.load_ranks(f.read()).items()}[piece].decode()


def test_encoding_matches_the_tokenizer_and_decodes(spark):
    rows = [(k, t, "x", "y", "z", 1) for k, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows + rows[:3], CLASH)
    got = tokens.encode_corpus(df, block_chars=3000)
    found = {r.doc_id: list(r.ids) for r in got.collect()}
    assert got.count() == len(TEXTS)
    assert found == dict(enumerate(reference_encode([t or "" for t in TEXTS])))
    back = {r.doc_id: r.text for r in tokens.decode_corpus(got).collect()}
    assert back == {k: t or "" for k, t in enumerate(TEXTS)}
    assert {r.doc_id: r.text for r in tokens.decode_corpus(got, block_ids=3).collect()} == back
    odd = spark.createDataFrame([(1, [64, 64]), (1, [64, 64]), (1, []), (2, None), (3, [10**9])], "doc_id long, ids array<int>")
    assert sorted((r.doc_id, r.text) for r in tokens.decode_corpus(odd).collect()) == [(1, ""), (1, back_of(64) * 2), (1, back_of(64) * 2), (2, ""), (3, "")]


def test_encoding_nothing(spark):
    assert tokens.encode_corpus(spark.createDataFrame([], CLASH)).count() == 0
    only = tokens.encode_corpus(spark.createDataFrame([(1, None, "", "", "", 0)], CLASH)).collect()
    assert [(r.doc_id, list(r.ids)) for r in only] == [(1, [])]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" '\n\tstmdrevl\u00a0\u3000"), st.characters(codec="utf-8", exclude_categories=["Cs", "Cn"])), max_size=40), max_size=5))
def test_words_are_those_of_the_pattern(texts):
    import regex

    words, row = textkernel.bpe_words(pa.array(texts, pa.string()))
    words = words.to_pylist()
    pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
    for k, t in enumerate(texts):
        if not set(t) & set("\x1c\x1d\x1e\x1f"):  # not white space in Unicode's list, but for this library
            assert words[row[k] : row[k + 1]] == pattern.findall(t)


def brute_leaks(docs, items, n):
    split = lambda t: [w.lower() for w in re.findall(r"[^\W_]+", t or "")]
    grams = lambda t: {tuple(w[k : k + n]) for w in [split(t)] for k in range(len(w) - n + 1)}
    return {(d, i) for d, t in docs for i, u in items if grams(t) & grams(u)}


def test_leaks_against_brute_force(spark):
    rng = np.random.default_rng(2)
    word = lambda: "w" + str(rng.integers(0, 40))
    items = [(k, " ".join(word() for _ in range(30))) for k in range(6)] + [(6, None), (7, ""), (8, "too short")]
    docs = []
    for k in range(40):
        t = " ".join(word() for _ in range(20))
        a = items[k % 6][1].split()
        part = " ".join(a[k % 9 : k % 9 + 3 + k % 12])
        docs.append((k, f"{t} {part.upper() if k % 2 else part}, {t}"))
    docs += [(50, None), (51, ""), (52, " ".join(items[0][1].split()[15:] + items[0][1].split()[:15]))]
    d = spark.createDataFrame(docs + docs[:2], "doc_id long, text string")
    i = spark.createDataFrame(items + items[:1], "item_id long, item_text string")
    got = leakage.find_leaks(d, i, min_match=8).collect()
    assert {(r.doc_id, r.item_id) for r in got} == brute_leaks(docs, items, 8) and len(got) == len({(r.doc_id, r.item_id) for r in got})
    moved = next(r for r in got if (r.doc_id, r.item_id) == (52, 0))
    assert moved.covered == 30 and moved.tiles == 2 and moved.longest == 15 and moved.coverage == 1.0
    assert leakage.find_leaks(d.limit(0), i).count() == 0 and leakage.find_leaks(d, i.limit(0)).count() == 0


def test_coverage_decides_reordered_passages(spark):
    words = [f"w{k}" for k in range(40)]
    parts = [words[k : k + 8] for k in range(0, 40, 8)]
    mixed = " ".join(w for k in (3, 0, 4, 1, 2) for w in [*parts[k], "between"])
    docs = [(1, mixed), (2, " ".join(parts[2]) + " and nothing else"), (3, " ".join(parts[0] + ["x"] + parts[4])), (1, " ".join(words))]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame([(7, " ".join(words))], "item_id long, item_text string")
    found = lambda **how: sorted((r.doc_id, r.tiles, r.longest, r.covered) for r in leakage.find_leaks(d, i, **how).collect())
    assert found(min_match=5) == [(1, 1, 40, 40), (1, 5, 8, 40), (2, 1, 8, 8), (3, 2, 8, 16)]
    assert found(min_match=5, min_coverage=0.5) == [(1, 1, 40, 40), (1, 5, 8, 40)]
    assert found() == [(1, 1, 40, 40)]


def test_tiles_do_not_overlap():
    a = np.array([0, 1, 2, 10, 11, 0])
    b = np.array([5, 6, 7, 6, 7, 20])
    got = leakage.tile(a, b, 3)
    assert got[0] == (0, 5, 5)
    for x, y in itertools.combinations(got, 2):
        assert (x[0] + x[2] <= y[0] or y[0] + y[2] <= x[0]) and (x[1] + x[2] <= y[1] or y[1] + y[2] <= x[1])


def brute_pairs(rows, threshold=0.6):
    sets = {}
    for k, t in rows:
        w = [x.lower() for x in re.findall("[A-Za-z0-9_]+", t or "")]
        if len(w) >= 20:
            sets[k] = set(zip(w, w[1:], w[2:]))
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold}


@pytest.mark.parametrize("block", [4000, 5])
def test_near_pairs_against_brute_force(spark, block):
    rng = np.random.default_rng(5)
    base = [[f"t{rng.integers(0, 3000)}" for _ in range(60)] for _ in range(12)]
    rows = []
    for k in range(150):
        w = list(base[k % 12])
        for _ in range(int(rng.integers(0, 9))):
            w[int(rng.integers(0, 60))] = f"e{rng.integers(0, 10**6)}"
        rows.append((k, " ".join(w)))
    rows += [(200, None), (201, ""), (202, "short text"), (203, rows[0][1].upper()), (204, rows[0][1]), (205, ", ".join(rows[0][1].split()))]
    df = spark.createDataFrame([(a, b, 1, "x") for a, b in rows + rows[:5]], "vec_id long, content string, id int, text string")
    got = [tuple(r) for r in neardup.near_pairs(df, block=block).collect()]
    want = brute_pairs(rows)
    assert set(got) == want and len(got) == len(want) and len(want) > 100


def test_near_pairs_of_nothing_and_classes(spark):
    schema = "vec_id long, content string"
    assert neardup.near_pairs(spark.createDataFrame([], schema)).count() == 0
    t = " ".join(f"w{k}" for k in range(30))
    members, links = neardup.near_classes(spark.createDataFrame([(3, t), (1, t), (2, t + " more")], schema))
    assert {(r.id, r.rep) for r in members.collect()} == {(1, 1), (3, 1), (2, 2)}
    assert [(r.rep_a, r.rep_b) for r in links.collect()] == [(1, 2)]


def test_trie_join_equals_all_pairs():
    rng = np.random.default_rng(1)
    s = rng.integers(0, 1 << 63, (300, 2)).astype(np.uint64)
    s[100:200] = s[:100] ^ (np.uint64(1) << rng.integers(0, 60, (100, 2)).astype(np.uint64))
    s = s[np.lexsort((s[:, 1], s[:, 0]))]
    i, j = np.triu_indices(len(s), 1)
    near = neardup._distance(s[i], s[j]) <= 20
    flat = (20,) * 129
    a, b, _ = neardup.trie_pairs(s, None, flat)
    assert {(min(x), max(x)) for x in zip(a.tolist(), b.tolist())} == set(zip(i[near].tolist(), j[near].tolist()))
    a, b, _ = neardup.trie_pairs(s[:150], s[150:], flat)
    assert len(a) == sum(1 for x, y in zip(i[near], j[near]) if x < 150 <= y)


def test_trie_join_prunes_families():
    """Families whose members differ in few bits: pairs across families go by the budget, at shared prefixes."""
    rng = np.random.default_rng(2)
    heads = rng.integers(0, 1 << 63, (40, 2)).astype(np.uint64)
    s = np.repeat(heads, 200, axis=0)
    s[:, 1] ^= rng.integers(0, 1 << 20, len(s)).astype(np.uint64)
    s = s[np.lexsort((s[:, 1], s[:, 0]))]
    allowed = neardup.prefix_budgets(47, 0.6)
    a, b, seen = neardup.trie_pairs(s, None, allowed)
    i, j = np.triu_indices(len(s), 1)
    near = neardup._distance(s[i], s[j]) <= 47
    family = np.arange(len(s)) // 200
    assert seen < 0.1 * len(i) and len(a) >= (family[i] == family[j])[near].sum()


def test_prefix_budgets_keep_similar_pairs():
    allowed = neardup.prefix_budgets(47, 0.6)
    assert allowed[0] == 0 and allowed[128] == 47 and all(x <= y <= x + 1 for x, y in zip(allowed, allowed[1:]))
    rng = np.random.default_rng(3)
    differ = np.cumsum(rng.random((20000, 128)) < 0.2, axis=1)
    assert (differ <= np.array(allowed[1:])).all(axis=1).mean() > 0.9999


@pytest.mark.parametrize("sample", [20_000, 400])
def test_crowded_keys_descend(spark, sample):
    """Texts that share a heading share keys of the first forest; the second keeps apart all but the similar ones."""
    rng = np.random.default_rng(6)
    head = [f"h{k}" for k in range(20)]
    rows = []
    for k in range(4000):
        own = [f"w{x}" for x in rng.integers(0, 10**6, 40)]
        rows.append((k, " ".join(head + own)))
        if k % 40 == 0:
            own[int(rng.integers(0, 40))] = "changed"
            rows.append((k + 10_000, " ".join(head + own)))
    df = spark.createDataFrame(rows, "vec_id long, content string")
    block, n = 150, len(rows)
    crowd = neardup.crowded_keys(neardup.signatures(df.select("vec_id", "content"), 28, 3, 20), block, 20_000)
    assert crowd.count() > 5
    base = df.select(F.col("vec_id").alias("id"), F.col("content").alias("text"), F.lit(0).cast("long").alias("s0"), F.lit(0).cast("long").alias("s1"))
    groups = neardup.deep_keys(base, 3).groupBy("tree").agg(F.count("*").alias("n"))
    compared = groups.agg(F.sum(F.expr("n * (n - 1) / 2"))).first()[0]
    assert compared < 0.05 * 51 * n * (n - 1) / 2 and groups.where("n > 1").count() > 51
    got = {tuple(r) for r in neardup.near_pairs(df, block=block, sample=sample).collect()}
    assert got == {(k, k + 10_000) for k in range(0, 4000, 40)}


def test_blocks_of_a_tree_are_pruned(spark):
    nodes = spark.createDataFrame([("t", 24, n) for n in (0, 1, 0xFFFFFF, 0xFFFFFE)], "tree string, depth int, node int")
    got = {(r.node, r.mate) for r in neardup.block_pairs(nodes, neardup.prefix_budgets(47, 0.6)).collect()}
    assert got == {(0, 0), (0, 1), (1, 1), (0xFFFFFE, 0xFFFFFE), (0xFFFFFE, 0xFFFFFF), (0xFFFFFF, 0xFFFFFF)}
