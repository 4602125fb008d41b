import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import vector_dedup


def by_hand(rows, cosine=0.9):
    """(vec_id, n_links, component_id, kept) of every row; all pairs."""
    units = []
    for _, v in rows:
        x = np.array([np.nan if a is None else a for a in v or []], float)
        ok = len(x) and np.isfinite(x).all() and x.any()
        units.append(x / np.abs(x).max() / np.linalg.norm(x / np.abs(x).max()) if ok else None)
    root = {i: i for i, _ in rows if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = [0] * len(rows)
    for k, ((i, _), x) in enumerate(zip(rows, units)):
        for n, ((j, _), y) in enumerate(zip(rows, units)):
            if k != n and None not in (i, j) and x is not None and y is not None and len(x) == len(y) and x @ y >= cosine:
                links[k] += 1
                low, high = sorted((find(i), find(j)))
                root[high] = low
    return sorted(((i, n, None if i is None else find(i), i is None or find(i) == i) for (i, _), n in zip(rows, links)), key=repr)


def near(x, turn, rng):
    """A vector at that angle to x, in a random direction."""
    x = x / np.linalg.norm(x)
    y = rng.normal(size=len(x))
    y -= (y @ x) * x
    return np.cos(turn) * x + np.sin(turn) * y / np.linalg.norm(y)


def planted(rng, dim=24):
    limit, base = np.arccos(0.9), [rng.normal(size=dim) for _ in range(8)]
    out = [rng.normal(size=dim) for _ in range(250)]
    out += [base[0]] * 60 + [base[0] * k for k in (2, 1e-30, 3e20)]  # equal, and of another length
    out += [near(base[1], rng.uniform(0, 0.12), rng) for _ in range(120)]  # a group whose pairs are all linked
    out += [near(base[2], limit / 2 * rng.choice([0.9, 1.1, 1.6]), rng) for _ in range(90)]  # balls that touch
    out += [near(base[3], limit * rng.choice([0.98, 0.999, 1.001, 1.02]), rng) for _ in range(40)] + [base[3]]  # around one vector
    chain = base[4]
    for _ in range(30):  # each links to the one before
        chain = near(chain, limit * 0.8, rng)
        out.append(chain)
    return out


@pytest.mark.parametrize("shard", [48, 2048])
def test_near_vectors_against_all_pairs(spark, monkeypatch, shard):
    monkeypatch.setattr(vector_dedup, "SHARD", shard)
    rng = np.random.default_rng(11)
    rows = [(3 * k + 5, x.tolist()) for k, x in enumerate(planted(rng))]
    nan, inf = float("nan"), float("inf")
    rows += [(1, None), (2, []), (3, [0.0] * 24), (4, [1.0, None] * 12), (6, [nan, 1.0] * 12), (7, [inf, 1.0] * 12)]
    rows += [(None, rows[300][1]), (None, None)]  # a copy without an id stays alone
    rows += [(8, [1.0, 2.0]), (10, [2.0, 4.1]), (13, [1.0, 2.0, 0.0]), (16, [-1.0, -2.0])]  # other dimensions
    rows += [(5, rows[0][1]), (5, rows[100][1]), (9, rows[50][1]), (9, None), (1_000_000, [0.0])]  # repeated ids
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    d = d.withColumns({"label": F.lit(1), "blob": F.lit("x"), "cls": F.lit(2), "near": F.lit(3)})
    found, recall = vector_dedup.near_vectors(d)
    found, want = sorted((tuple(r) for r in found.collect()), key=repr), by_hand(rows)
    linked = sum(r[1] for r in want)
    missing = sum(max(0, w[1] - f[1]) for w, f in zip(want, found))
    assert [f[0] for f in found] == [w[0] for w in want] and all(f[1] <= w[1] for f, w in zip(found, want))
    assert missing <= 0.01 * linked and recall >= 0.9
    if not missing:
        assert found == want


def test_single_precision_whole_numbers_and_none(spark):
    rng = np.random.default_rng(3)
    group = [near(np.ones(16), 0.1 + 0.02 * (k % 9), rng) for k in range(80)]
    rows = [(k, np.float32(x).tolist()) for k, x in enumerate([*group, *rng.normal(size=(60, 16))])]
    found, recall = vector_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert sorted((tuple(r) for r in found.collect()), key=repr) == by_hand(rows) and recall == 1
    rows = [(k, [k % 5, k % 3, 1]) for k in range(30)]
    found, _ = vector_dedup.near_vectors(spark.createDataFrame(rows, "vec_id int, e array<int>"), vector="e")
    assert sorted((tuple(r) for r in found.collect()), key=repr) == by_hand(rows)
    found, recall = vector_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert found.collect() == [] and recall == 1
    found, _ = vector_dedup.near_vectors(spark.createDataFrame([(1, None), (2, [0.0])], "vec_id long, embedding array<float>"))
    assert sorted(map(tuple, found.collect())) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_edges_reach_all_and_the_search_finds_what_is_in_range():
    rng = np.random.default_rng(5)
    x = np.concatenate([near(c, 0.3, rng)[None] for c in rng.normal(size=(6, 12)) for _ in range(40)])
    a, b = vector_dedup._edges(x, rng)
    n = len(x)
    reached = {vector_dedup._medoid(x)}
    while len(new := reached | {int(t) for f, t in zip(a, b) if int(f) in reached}) > len(reached):
        reached = new
    assert len(reached) == n
    lists = [np.unique(b[a == i]) for i in range(n)]
    adjacency = np.full((n, max(map(len, lists))), -1)
    for i, own in enumerate(lists):
        adjacency[i, : len(own)] = own
    met = vector_dedup._found(x, vector_dedup._medoid(x), adjacency, x, np.full(n, 0.9))
    inside = x @ x.T >= 0.9
    assert (met[inside] >= 0.9 - 1e-9).mean() >= 0.99
    assert np.allclose(met[met > -np.inf], (x @ x.T)[met > -np.inf])


def test_dense_places_take_members_that_are_all_linked():
    rng = np.random.default_rng(6)
    x = np.float32([near(np.ones(32), 0.08, rng) for _ in range(50)] + list(rng.normal(size=(200, 32))))
    half = np.arccos(0.9) / 2
    _, dense = vector_dedup._fitted([v.tobytes() for v in x], "<f4", 1.0, half)
    first, middles = dense[32]
    assert (first, len(middles)) == (0, 1)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    assert ((unit @ middles[0] >= np.cos(half)) == ([True] * 50 + [False] * 200)).all()
