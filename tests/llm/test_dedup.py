import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from sitelore.llm import components, exactdedup, grams, lengths, neardup

SCHEMA = "doc_id long, text string, lang string, keep_id string, kept string"


def rows(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "own", "own") for i, t in zip(ids, texts)], SCHEMA)


def test_exact_groups_against_brute_force(spark):
    rng = random.Random(1)
    texts = [rng.choice(["a", "a ", "A", "", None, "b" * 200, "b" * 199 + "c", "long " * 50, "x%d" % rng.randint(0, 5)]) for _ in range(300)]
    for few in (100_000, 1):
        got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exactdedup.exact_groups(rows(spark, texts), broadcast_cells=few).collect()}
        plain = [t or "" for t in texts]
        last = {t: i for i, t in enumerate(plain)}
        count = Counter(plain)
        assert got == {i: (last[t], count[t], last[t] == i) for i, t in enumerate(plain)}


def test_exact_edges(spark):
    empty = rows(spark, [])
    assert exactdedup.exact_groups(empty).count() == 0 and exactdedup.drop_exact(empty).count() == 0
    got = {(r.doc_id, r.kept) for r in exactdedup.exact_groups(rows(spark, ["t", "t", "t", "u"], [5, 5, 2, None])).collect()}
    assert got == {(5, True), (2, False), (None, False)}
    again = rows(spark, ["same"] * 3 + ["x", "x", "y", None, None], [4, 4, 1, 7, 7, 7, 8, 8])
    assert sorted((r.doc_id, r.text or "") for r in exactdedup.drop_exact(again).collect()) == [(4, "same"), (7, "x"), (7, "y"), (8, "")]
    docs = rows(spark, ["same", "same", "other", None], [1, 2, 3, None])
    kept = exactdedup.drop_exact(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id, r.kept) for r in kept.collect()) == [(False, 2, "own"), (False, 3, "own"), (True, None, "own")]


def brute(texts, n=5):
    """Components of all pairs with 100 * both >= 75 * either, on sets of word tuples."""
    sets = []
    for t in texts:
        w = [x for x in re.split(rb"[\x20\x09-\x0d]+", (t or "").encode().lower()) if x]
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    u = components.Union()
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                u.join(i, j)
    return {i: (len(s), u.root(i) if i in u.up else i) for i, s in enumerate(sets)}


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    texts = []
    for _ in range(40):
        base = [rng.choice(words) for _ in range(rng.randint(1, 120))]
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 1, 3])):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append("\n ".join(copy).upper() if rng.random() < 0.3 else "\t".join(copy))
    family = [rng.choice(words) for _ in range(150)]
    for _ in range(60):  # a family whose members are spread out
        copy = list(family)
        for _ in range(rng.randint(0, 6)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        texts.append(" ".join(copy))
    texts += ["", None, "   ", "one two", "ONE\x0btwo", "one\xa0two", "Ä ö", "ä ö"]
    return texts


@pytest.mark.parametrize("options", [{}, {"family": 12, "region": 8, "finish": 5}, {"family": 7, "family_shingles": 900, "region": 64}])
def test_near_groups_against_brute_force(spark, options):
    texts = corpus(3)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_groups(rows(spark, texts), **options).collect()}
    want = brute(texts)
    assert got == {i: (n, c, i == c) for i, (n, c) in want.items()}


def test_near_edges(spark):
    assert neardup.near_groups(rows(spark, [])).count() == 0
    assert neardup.drop_near(rows(spark, [None, ""])).count() == 2
    docs = rows(spark, ["a b c d e f", "a b c d e f", "a b c d e f", "z"], [7, 7, None, 9])
    got = sorted((r.doc_id or 0, r.component_id, r.kept) for r in neardup.near_groups(docs).collect())
    assert got == [(0, 7, False), (7, 7, True), (7, 7, True), (9, 9, True)]
    assert neardup.drop_near(rows(spark, ["a b c d e f", "A b c d e f"])).select("doc_id", "kept").collect()[0] == (0, "own")


def test_word_hashes_follow_the_words():
    words = grams.Words(["The  the\x0bTHE é É", "", "the"])
    h = words.hashes
    assert words.first.tolist() == [0, 5, 5, 6]
    assert h[0] == h[1] == h[2] == h[5] and h[3] != h[4]
    a, b = (list(grams.shingle_sets([t]))[0] for t in ("a b c d e f a b c d e", "x a b c d e"))
    assert len(a) == 6 and len(np.intersect1d(a, b)) == 1


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 130)] + [(130, 130)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long"), finish=3).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{k: 100 for k in range(100, 130)}}


def test_components_of_a_long_chain(spark):
    """Ids in the order of the chain, the worst case for minima that move by one link a round."""
    start = time.time()
    links = spark.range(100_000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = components.components(links, finish=10).agg(F.count("*"), F.countDistinct("node"), F.max("component")).first()
    assert tuple(got) == (100_001, 100_001, 0) and time.time() - start < 60


def test_components_against_union_find(spark):
    rng = random.Random(8)
    links = [(rng.randrange(3000), rng.randrange(3000)) for _ in range(1800)] + [(5, None), (None, 6), (2, 2)]
    want = components.Union()
    for a, b in links:
        if a is not None and b is not None and a != b:
            want.join(a, b)
    for finish in (10**6, 3):
        got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long"), finish=finish).collect()}
        assert got == {x: want.root(x) for x in want.up}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def forest(ids, signatures, region, tasks):
    """The two passes over sorted rows, cut into so many tasks: the loose links."""
    nodes = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([s.tobytes() for s in signatures], pa.binary())], names=["id", "signature"])
    rows = pa.Table.from_batches(list(neardup._orders([nodes]))).sort_by([("region", "ascending"), ("rest", "ascending"), ("id", "ascending")])
    step = -(-rows.num_rows // tasks)
    starts = list(range(0, rows.num_rows, step))
    found = pa.concat_tables([pa.Table.from_batches(list(neardup._neighbours(region, k)(rows.slice(lo, step).to_batches(max_chunksize=100)))) for k, lo in enumerate(starts)])
    edges = found.filter(pc.is_null(found["b"]))
    key = [hash(x) for x in zip(edges["region"].to_pylist(), edges["border"].to_pylist())]
    edges = pa.table({"region": pa.array(key, pa.int64()), "rest": edges["rest"], "id": edges["a"], "whole": edges["whole"]}).sort_by([("region", "ascending"), ("rest", "ascending"), ("id", "ascending")])
    second = pa.Table.from_batches(list(neardup._neighbours(region, 0)(edges.to_batches(max_chunksize=70))))
    links = pa.concat_tables([found, second])
    links = links.filter(pc.is_valid(links["b"]))
    return list(zip(links["a"].to_pylist(), links["b"].to_pylist()))


@pytest.mark.parametrize("region, tasks", [(8, 1), (8, 7), (8, 900), (64, 3), (4096, 5), (4096, 1500)])
def test_rows_with_a_deep_common_prefix_meet(region, tasks):
    """Whatever the size of a region and wherever tasks cut it, two near rows that share DEEPEST values of an order are in one cluster."""
    rng = np.random.default_rng(region + tasks)
    base = rng.integers(0, 2**32, (6, neardup.VALUES), dtype=np.uint32)
    sigs = base[rng.integers(0, 6, 400)].copy()
    sigs[rng.random(sigs.shape) < 0.25] = 1  # a common value of unrelated rows makes large regions
    other = rng.random(sigs.shape) < 0.12
    sigs[other] = rng.integers(0, 2**32, int(other.sum()), dtype=np.uint32)
    sets = components.Union()
    for a, b in forest(np.arange(400), sigs, region, tasks):
        sets.join(a, b)
    turned = sigs[:, neardup._sequences()[:, : neardup.DEEPEST]]
    for i in range(400):
        deep = (turned == turned[i]).all(2).any(1)
        for j in np.flatnonzero(deep & ((sigs == sigs[i]).sum(1) >= neardup.LOOSE + 3)):
            assert sets.root(i) == sets.root(int(j)), (i, j)


@pytest.mark.parametrize("region, tasks", [(512, 4), (4096, 40)])
def test_recall_in_large_regions(region, tasks):
    """10,000 pairs near the threshold that share a region in seven orders only, each of which is one region of 20,000 rows."""
    rng = np.random.default_rng(4)
    n, seq = 10_000, neardup._sequences()
    first = rng.integers(0, 2**32, (n, neardup.VALUES), dtype=np.uint32)
    first[:, seq[:7, : neardup.DEPTH].ravel()] = 7
    second = first.copy()
    for k in range(7, neardup.ORDERS):
        second[np.arange(n), seq[k][rng.integers(0, neardup.DEPTH, n)]] = rng.integers(0, 2**32, n, dtype=np.uint32)
    more = (rng.random(second.shape) < 0.05) & (second != 7)
    second[more] = rng.integers(0, 2**32, int(more.sum()), dtype=np.uint32)
    assert 0.7 < (first == second).mean() < 0.8
    sets = components.Union()
    for a, b in forest(np.arange(2 * n), np.concatenate([first, second]), region, tasks):
        sets.join(a, b)
    found = np.mean([sets.root(i) == sets.root(n + i) for i in range(n)])
    assert found >= 0.99, found


def test_loose_families_larger_than_a_part(spark):
    """Texts that share a boilerplate half, so that they are one loose family with many exact clusters."""
    rng = random.Random(2)
    shared = [f"s{k}" for k in range(60)]
    texts = []
    for k in range(130):
        own = [f"t{k}_{rng.randrange(10**6)}" for _ in range(24)]
        texts.append(" ".join(shared + own))
        if k % 3 == 0:
            own[-1] = "changed"
            texts.append(" ".join(shared + own))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_groups(rows(spark, texts), family=20).collect()}
    assert got == brute(texts)


def test_histogram_answers_every_limit(spark):
    rng = random.Random(5)
    values = [0, 0, 1, 5000, 5000, 1024, 1023] + [rng.randint(0, 3000) for _ in range(400)]
    table = lengths.histogram(spark.createDataFrame([(v,) for v in values], "n_tokens long")).cache()
    for r in table.collect():
        inside = [v for v in values if v <= r.n_tokens]
        assert (r.n_docs, r.docs_within, r.tokens_within) == (values.count(r.n_tokens), len(inside), sum(inside))
        assert (r.docs_over, r.tokens_over, r.tokens_cut) == (len(values) - len(inside), sum(values) - sum(inside), sum(min(v, r.n_tokens) for v in values))
    for limit in (0, 7, 2048, 10**6):
        r = lengths.at_limit(table, limit).first()
        assert (r.docs_within, r.tokens_cut) == (sum(v <= limit for v in values), sum(min(v, limit) for v in values))
    s = sorted(values)
    assert {r.share: r.n_tokens for r in lengths.quantiles(table, [0.5, 0.9]).collect()} == {q: s[int(np.ceil(q * len(s))) - 1] for q in (0.5, 0.9)}
    empty = lengths.histogram(spark.createDataFrame([], "n_tokens long"))
    assert empty.count() == 0 and lengths.at_limit(empty, 9).first().docs_within == 0
