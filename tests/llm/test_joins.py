"""N-gram join and top-k search against brute force."""

import random
import re

import numpy as np
import pytest

from pyspark.sql import functions as F

from merchlake.llm import mtree_topk, ngram_join
from merchlake.llm.batches import prepare
from merchlake.llm.components import components

SEPARATED = re.compile(r"[^\x20\x09-\x0D]+")


def grams(text, n):
    words = SEPARATED.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < n:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def brute_join(rows, n, num, den):
    sets = [grams(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = [0] * len(rows)
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and den * both >= num * (len(a) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return [(rows[i][0], len(sets[i]), least.get(find(i), rows[i][0]), links[i]) for i in range(len(rows))]


def corpus(seed, size):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(size):
        if texts and rng.random() < 0.6:
            words = rng.choice(texts).split()
            for _ in range(rng.choice([0, 1, 1, 2, 4, 9])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            if rng.random() < 0.2:
                words += rng.choices(vocabulary, k=rng.randint(1, 9))
        else:
            words = rng.choices(vocabulary, k=rng.choice([1, 2, 3, 8, 12, 20, 40, 90, 200]))
        texts.append(" ".join(words))
    return texts


def key(row):
    return tuple((x is None, x or 0) for x in row)


@pytest.mark.parametrize("n, num, den", [(3, 90, 100), (5, 80, 100)])
def test_join_equals_brute_force(spark, monkeypatch, n, num, den):
    prepare(spark)
    # Small row blocks, so that groups span several; tasks get the value with the function.
    rows = list(enumerate(corpus(n, 300), 10))
    rows += [(1, None), (2, ""), (3, " \t\n "), (4, "One  TWO"), (5, "one two"), (None, "one\x0btwo"), (6, "é É"), (7, "é é")]
    rows += [(8, "a b c d e f g h i j k l " * 2000), (8, "A b c d e f g h i j k l " * 2000), (9, rows[20][1].upper())]
    table = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, id int, row int")
    got = ngram_join.ngram_join(table, n=n, num=num, den=den).collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute_join(rows, n, num, den), key=key)


def test_join_over_several_row_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "ROW_BLOCK", 16)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(100):
        words = list(base)
        words[i % 60] = f"x{i}"
        rows.append((i, " ".join(words)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.ngram_join(table, n=3, num=80, den=100).collect()
    assert sorted(map(tuple, got)) == sorted(brute_join(rows, 3, 80, 100))


def near_pairs(size):
    """Near copies two by two, all under the same long line."""
    rng = random.Random(11)
    line = " ".join(f"c{i}" for i in range(60))
    rows = []
    for i in range(size):
        words = [f"w{rng.randrange(10**6)}" for _ in range(120)]
        for copy in range(2):
            words[60 + copy] = f"x{copy}"
            rows.append((2 * i + copy, line + " " + " ".join(words)))
    return rows


def test_a_common_line_connects_no_rows(spark, monkeypatch):
    prepare(spark)
    rows = near_pairs(40)
    grouped = []
    found = ngram_join.components
    monkeypatch.setattr(ngram_join, "components", lambda edges: grouped.append(found(edges)) or grouped[-1])
    got = ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string"), n=5, num=80, den=100).collect()
    assert sorted(map(tuple, got)) == sorted(brute_join(rows, 5, 80, 100))
    sizes = [r["count"] for r in grouped[0].groupBy("component").count().collect()]
    assert len(sizes) == 40 and max(sizes) == 2


@pytest.mark.parametrize("group", [1, 2, 5])
def test_join_where_most_block_rows_are_common(spark, monkeypatch, group):
    prepare(spark)
    monkeypatch.setattr(ngram_join, "PAIR_GROUP", group)
    rng = random.Random(group)
    lines = [" ".join(f"v{rng.randrange(300)}" for _ in range(rng.randint(3, 30))) for _ in range(12)]
    rows = []
    for i, text in enumerate(corpus(group, 200)):
        parts = rng.sample(lines, rng.randint(0, 5)) + ([text] if rng.random() < 0.8 else [])
        rows.append((i, " ".join(parts)))
    # Copies in several tasks.
    rows += [(1000 + i, rows[i % 7][1]) for i in range(40)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = ngram_join.ngram_join(table, n=5, num=80, den=100).collect()
    assert sorted(map(tuple, got)) == sorted(brute_join(rows, 5, 80, 100))


def test_join_of_empty_and_unlinked_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.ngram_join(none).count() == 0
    one = spark.createDataFrame([(3, "a b c d")], "doc_id long, text string")
    assert [tuple(r) for r in ngram_join.ngram_join(one).collect()] == [(3, 2, 3, 0)]


def test_scheme_gives_linked_rows_a_common_block():
    scheme, rng = ngram_join.BlockScheme(90, 100), random.Random(5)
    for _ in range(400):
        size = rng.choice([5, 9, 10, 12, 15, 19, 30, 77, 300, 900])
        a = {rng.getrandbits(64) for _ in range(size)}
        b = set(a)
        while True:
            c = set(b)
            if rng.random() < 0.5 and len(c) > 1:
                c.discard(rng.choice(sorted(c)))
            else:
                c.add(rng.getrandbits(64))
            if 100 * len(a & c) < 90 * len(a | c):
                break
            b = c
        if a != b:
            rows = [np.array(sorted(x), np.uint64) for x in (a, b)]
            assert set(scheme.keys(rows[0]).tolist()) & set(scheme.keys(rows[1]).tolist())


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1040)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            low, high = sorted((find(a), find(b)))
            parent[high] = low
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}


VECTORS = "vec_id long, embedding array<float>, tree string, score int"


def brute_top_k(rows, k, step):
    good = {}
    for vec_id, v in rows:
        if v is not None and vec_id is not None and all(x is not None and np.isfinite(x) for x in v):
            good[vec_id] = np.floor(np.array(v, np.float32).astype(np.float64) * 64)
    found = []
    for q, a in good.items():
        if q % step == 0:
            scored = sorted((-int(a[: len(b)] @ b[: len(a)]), i) for i, b in good.items() if i != q)[:k]
            found += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored, 1)]
    return sorted(found)


def test_top_k_equals_brute_force(spark, monkeypatch):
    prepare(spark)
    monkeypatch.setattr(mtree_topk, "TREE_ROWS", 128)
    monkeypatch.setattr(mtree_topk, "QUERY_BLOCK", 16)
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(700)]
    # A common vector, vectors that take no part, and shorter ones.
    rows += [(i, [1.0] * 8) for i in range(1000, 1400)]
    rows += [(2000, None), (2020, [1.0, None]), (2040, [float("nan")] * 8), (2060, [float("inf")] * 8), (2080, [2.0, 1.0]), (2100, [])]
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], VECTORS)
    got = mtree_topk.top_k(table, F.col("vec_id") % 20 == 0, k=20).collect()
    assert sorted(map(tuple, got)) == brute_top_k(rows, 20, 20)


def test_top_k_of_few_rows(spark):
    table = spark.createDataFrame([(0, [1.0], "x", 1), (20, [2.0], "x", 1), (0, [1.0], "x", 1)], VECTORS)
    got = mtree_topk.top_k(table.dropDuplicates(), F.col("vec_id") % 20 == 0).collect()
    assert sorted(map(tuple, got)) == [(0, 1, 20, 64 * 128), (20, 1, 0, 64 * 128)]
    assert mtree_topk.top_k(table.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert mtree_topk.top_k(table, F.col("vec_id") == 7).count() == 0


def test_the_tree_leaves_pages_out():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 3)) * 400
    points = np.concatenate([c + rng.normal(size=(100, 3)) * 3 for c in centres]).round()
    norm = float((points**2).sum(axis=1).max())
    import pandas as pd

    frame = pd.DataFrame(
        {"tree": 0, "id": np.arange(len(points)), "vector": [p.astype("<i4").tobytes() for p in points]}
    )
    tree = mtree_topk.Tree(mtree_topk._builder(norm)(frame), norm)
    queries = points[::200]
    who, ids, scores = tree.search(queries, np.arange(len(points))[::200], 5)
    assert tree.computed < 0.6 * len(points) * len(queries)
    for q in range(len(queries)):
        every = points @ queries[q]
        every[q * 200] = -np.inf
        assert sorted(scores[who == q].tolist()) == sorted(np.sort(every)[-5:].astype(int).tolist())


def test_copies_beside_a_long_vector():
    for trial in range(60):
        rng = np.random.default_rng(trial)
        one = rng.integers(-64, 64, 64).astype(float)
        vectors = np.concatenate([np.tile(one, (200, 1)), one[None] * (2, 3, 10)[trial % 3]])
        norm = float((vectors**2).sum(axis=1).max())
        pages = mtree_topk.build_pages(mtree_topk.lifted(vectors, norm), norm)
        held = np.concatenate([p["entries"] for p in pages if p["leaf"]])
        assert sorted(held.tolist()) == list(range(201))


def test_top_k_of_large_components(spark):
    prepare(spark)
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(60)]
    rows += [(100, [4e7, 1.0, 0.0, 0.0]), (101, [-3.5e7, 2.0, 0.5, 1.0]), (102, [4e7, 1.0, 0.0, 0.0]), (103, [3e5, 1.0, 2.0]), (120, [0.0, 1e9])]
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], VECTORS.replace("float", "double"))
    good = {i: [int(np.floor(x * 64)) for x in v] for i, v in rows}
    expected = []
    for q in (q for q in good if q % 20 == 0):
        scored = sorted((-sum(a * b for a, b in zip(good[q], v)), i) for i, v in good.items() if i != q)[:5]
        expected += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored, 1)]
    got = mtree_topk.top_k(table, F.col("vec_id") % 20 == 0, k=5).collect()
    assert sorted(map(tuple, got)) == sorted(expected)
