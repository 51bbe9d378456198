"""Near-duplicates against all pairs."""

import random
import re

import numpy as np
import pytest

import tessel.llm.odd_sketches as module
from tessel.llm.components import components
from tessel.llm.odd_sketches import BITS, MOST_BITS, SAMPLES, maybe_among, min_hashes, near_duplicates, odd_sketch, without_near_copies


def plain(data, size):
    sets = {}
    for i, x in data:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in x or ""))
        k = min(size, len(words))
        sets[i] = {tuple(words[j : j + k]) for j in range(len(words) - k + 1)} if k else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def some_texts(seed, n):
    r = random.Random(seed)
    base = [[str(r.randrange(3000)) for _ in range(r.choice([1, 2, 6, 30, 120, 400]))] for _ in range(n)]
    out = [None, "", " \n", "a", "A", "a b", "A  b", "b a", "É é", "é é", "x " * 5000, "X " * 100]
    for _ in range(6 * n):
        words = list(r.choice(base))
        for _ in range(int(len(words) * r.choice([0, 0.01, 0.03, 0.05, 0.06, 0.1]))):
            words[r.randrange(len(words))] = str(r.randrange(3000))
        out.append(" ".join(words).upper() if r.random() < 0.2 else "\n".join(words))
    return out


@pytest.mark.parametrize(("size", "block", "size_bytes", "hot"), [(2, 2000, 1 << 25, 256), (5, 3, 1 << 25, 1), (3, 2000, 500, 1 << 20)])
def test_components_of_texts(spark, monkeypatch, size, block, size_bytes, hot):
    monkeypatch.setattr(module, "BLOCK", block)
    monkeypatch.setattr(module, "BLOCK_BYTES", size_bytes)
    monkeypatch.setattr(module, "HOT_PARTS", hot)
    monkeypatch.setattr(module, "HOT_BUCKETS", hot)
    data = list(enumerate(some_texts(size, 25), 7))
    random.Random(1).shuffle(data)
    got = near_duplicates(spark.createDataFrame([(*x, 1) for x in data], "doc_id long, text string, _n int").repartition(4), size).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == plain(data, size) and len(got) == len(data)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_no_rows_and_repeated_ones(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = near_duplicates(spark.createDataFrame([(1, "a b c")] * 3 + [(2, None)] * 2, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(1, 1, True)] * 3 + [(2, 2, True)] * 2


@pytest.mark.parametrize("block", [3000, 4])
def test_near_the_bound(spark, monkeypatch, block):
    """A crowd of texts around the bound: many share buckets, some are linked, and each link counts."""
    monkeypatch.setattr(module, "BLOCK", block)
    r = random.Random(5)
    base = [str(k) for k in range(60)]
    data = []
    for i in range(60):
        words = list(base)
        for _ in range(r.choice([2, 3, 4, 5])):
            words[r.randrange(60)] = f"n{r.randrange(10_000)}"
        data.append((i, " ".join(words)))
    got = near_duplicates(spark.createDataFrame(data, "doc_id long, text string").repartition(4), 2).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == plain(data, 2) and 1 < len({x.component_id for x in got}) < 60


def test_rows_without_ids_and_clashing_columns(spark):
    text = " ".join(str(k) for k in range(40))
    other = " ".join(f"o{k}" for k in range(40))
    rows = [(5, text), (None, text), (None, text + " x"), (None, other), (None, other), (7, other + " y"), (None, "alone here"), (None, "alone here"), (None, None), (9, None)]
    docs = spark.createDataFrame([(i, x, "a", "b", 3) for i, x in rows], "doc_id int, text string, _gone string, _own string, _id int")
    got = near_duplicates(docs).collect()
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in got), key=str) == sorted([(5, 5, True), (None, 5, False), (None, 5, False), (None, 7, False), (None, 7, False), (7, 7, True), (None, None, True), (None, None, False), (None, None, True), (9, 9, True)], key=str)
    left = without_near_copies(docs)
    assert left.columns == docs.columns and left.schema["doc_id"].dataType.simpleString() == "int"
    assert sorted(((r.doc_id, r.text, r._gone, r._own, r._id) for r in left.collect()), key=str) == sorted([(5, text, "a", "b", 3), (7, other + " y", "a", "b", 3), (None, "alone here", "a", "b", 3), (None, None, "a", "b", 3), (9, None, "a", "b", 3)], key=str)


def broadcast_rows(spark, since):
    """The rows of each broadcast of the plans run after number ``since``."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    store, out = spark._jsparkSession.sharedState().statusStore(), []
    each = lambda x: (x.apply(k) for k in range(x.size()))
    for run in each(store.executionsList().toVector()):
        if run.executionId() <= since:
            continue
        values = store.executionMetrics(run.executionId())
        for node in each(store.planGraph(run.executionId()).allNodes().toVector()):
            if node.name() == "BroadcastExchange":
                found = [values.get(m.accumulatorId()) for m in each(node.metrics().toVector()) if m.name() == "number of output rows"]
                out += [int(x.get().replace(",", "")) for x in found if x.isDefined()]
    return out


def test_broadcasts_do_not_follow_the_input(spark, monkeypatch):
    """The ids of texts whose sets are needed aren't broadcast, only a filter of them, however small it is."""
    monkeypatch.setattr(module, "HOT_PARTS", 1)
    monkeypatch.setattr(module, "HOT_BUCKETS", 1)
    r = random.Random(9)
    data = []
    for i in range(0, 600, 2):
        words = [f"w{r.randrange(5000)}" for _ in range(30)]
        data += [(i, " ".join(words)), (i + 1, " ".join([*words, "end"]))]
    before, limit = 0, spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        docs = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
        docs.count()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        runs = spark._jsparkSession.sharedState().statusStore().executionsList().toVector()
        before = max(runs.apply(k).executionId() for k in range(runs.size()))
        got = near_duplicates(docs, 2).collect()
        rows = broadcast_rows(spark, before)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert {x.doc_id: x.component_id for x in got} == {i: i - i % 2 for i in range(600)}
    assert rows and max(rows) <= 16


@pytest.mark.parametrize(("parts", "n", "most"), [(1024, 20_000, 0.03), (1, 20_000, 0.3), (1, 0, 0)])
def test_filter_of_ids(spark, monkeypatch, parts, n, most):
    """No id is lost, and few others come through, with a full filter more of them."""
    monkeypatch.setattr(module, "FILTER_PARTS", parts)
    rows = spark.range(-50_000, 50_000).selectExpr("id AS k", "'x' AS _hash")
    got = maybe_among(rows, "k", spark.range(0, 2 * n, 2).select("id"), n)
    assert got.columns == rows.columns
    ids = {x.k for x in got.collect()}
    assert ids >= set(range(0, 2 * n, 2)) and len(ids) - n <= most * 100_000


def test_links_in_chains(spark):
    pairs = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)] + [(5, 5), (200, 201), (201, 200)]
    random.Random(0).shuffle(pairs)
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 130)} | {200: 200, 201: 200}


def test_estimates():
    """The XOR of two sketches tells their similarity; the bound lets every pair of 0.8 pass."""
    r = np.random.default_rng(0)
    for common in (889, 444):
        pop = []
        for _ in range(60):
            x = r.integers(0, 1 << 63, 1000, dtype=np.uint64)
            y = np.concatenate([x[: common], r.integers(0, 1 << 63, 1000 - common, dtype=np.uint64)])
            a, b = odd_sketch(min_hashes([x, y]))
            pop.append(int(np.bitwise_count((a ^ b).view(np.uint64)).sum()))
        s = common / (2000 - common)
        want = BITS / 2 * (1 - (1 - 2 / BITS) ** (2 * SAMPLES * (1 - s)))
        assert abs(np.mean(pop) - want) < 6
        if s > 0.79:
            assert max(pop) <= MOST_BITS
