"""What grew too fast with the tables: work that is counted, against slow versions."""

from __future__ import annotations

import random
import uuid

from pyspark.sql import functions as F

from palimpsest.functions.similarity import indel_ratio
from palimpsest.operators import graph as G
from palimpsest.operators import resolve as R
from palimpsest.operators import tabular as O


def jobs(spark, run):
    """What run gives, and the number of Spark's jobs it took."""
    group = str(uuid.uuid4())
    spark.sparkContext.setJobGroup(group, "")
    try:
        return run(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def slow_labels(edges):
    label = {x: x for e in edges for x in e}
    for _ in label:
        for u, v in edges:
            label[u] = label[v] = min(label[u], label[v])
    return label


def slow_entries(pairs, start, least):
    entry = {}
    for t in sorted({t for *_, t in pairs}):
        label = slow_labels([(u, v) for u, v, x in pairs if x <= t])
        sizes = {c: list(label.values()).count(c) for c in label.values()}
        top = min(sizes, key=lambda c: (-sizes[c], c))
        if t >= start and sizes[top] >= least:
            for i, c in label.items():
                if c == top:
                    entry.setdefault(i, t)
    return entry


def test_entry_years_take_few_jobs(spark, monkeypatch):
    """Not some for each period; the same in one task, in parts and in rounds, ties of size among it."""
    rnd = random.Random(3)
    pairs = [tuple(sorted(rnd.sample(range(60), 2))) + (1970 + rnd.randrange(30),) for _ in range(70)] + [(100 + i, 101 + i, 1971 + i) for i in range(9)]
    d = spark.createDataFrame(pairs, "u long, v long, year int").repartition(5)
    want, years = slow_entries(pairs, 1975, 3), sorted({t for *_, t in pairs})
    got, n = jobs(spark, lambda: {r.id: r.year for r in G.entry_periods(d, "year", years, 1975, 3).collect()})
    assert got == want and n <= 20, n
    monkeypatch.setattr(G, "ONE", 80)  # partitions are thinned again
    assert {r.id: r.year for r in G.entry_periods(d, "year", years, 1975, 3).collect()} == want
    few = [p for p in pairs if p[2] < 1973]
    monkeypatch.setattr(G, "ONE", 2)  # too much for one task
    assert {r.id: r.year for r in G.entry_periods(spark.createDataFrame(few, "u long, v long, year int"), "year", sorted({t for *_, t in few}), 1971, 2).collect()} == slow_entries(few, 1971, 2)


def test_components_take_few_jobs(spark, monkeypatch):
    edges = [(i, i + 1) for i in range(0, 300) if i % 50] + [(7, 7), (900, 900), (20, 260), (500, 1)]
    d = spark.createDataFrame(edges, "u long, v long").repartition(6)
    want = slow_labels(edges)
    got, n = jobs(spark, lambda: {r.id: r.component for r in G.components(d).collect()})
    assert got == want and n <= 10, n
    for most in (350, 3):
        monkeypatch.setattr(G, "ONE", most)
        assert {r.id: r.component for r in G.components(d).collect()} == want


def slow_steps(edges, s):
    near = {x: set() for e in edges for x in e}
    for u, v in edges:
        near[u].add(v)
        near[v].add(u)
    far, at = {s: 0}, [s]
    for x in at:
        for y in sorted(near[x]):
            if y not in far:
                far[y] = far[x] + 1
                at.append(y)
    return far


def graphs():
    rnd = random.Random(5)
    yield [(i, i + 1) for i in range(12)] + [(100, 101), (100, 102)]
    yield [(i, (i + 1) % 9) if i < 8 else (0, 8) for i in range(9)] + [(20 + i, 20 + (i + 1) % 9) if i < 8 else (20, 28) for i in range(9)]
    for _ in range(4):
        yield sorted({tuple(sorted(rnd.sample(range(40), 2))) for _ in range(45)})


def test_diameter_takes_few_searches(spark, monkeypatch):
    """Not one from each vertex; no limit of 2,000,000 edges stands in the way of it."""
    monkeypatch.setattr(G, "path_centralities", None)
    for edges in graphs():
        label = slow_labels(edges)
        sizes = {c: list(label.values()).count(c) for c in label.values()}
        top = min(sizes, key=lambda c: (-sizes[c], c))
        want = max(max(slow_steps(edges, s).values()) for s, c in label.items() if c == top)
        assert tuple(G.diameter(spark.createDataFrame(edges, "u long, v long")).first()) == (sizes[top], want)
    assert tuple(G.diameter(spark.createDataFrame([], "u long, v long")).first()) == (0, None)


def test_katz_takes_few_jobs(spark, monkeypatch):
    edges = list(graphs())[-1]
    d = spark.createDataFrame(edges, "u long, v long")
    got, n = jobs(spark, lambda: {r.id: r.katz for r in G.katz(d).collect()})
    assert n <= 5, n
    monkeypatch.setattr(G, "ONE", 1)
    slow = {r.id: r.katz for r in G.katz(d).collect()}
    assert got.keys() == slow.keys() and all(abs(x - slow[i]) < 1e-7 for i, x in got.items())


def titles():
    rnd = random.Random(11)
    words = ["fouilles", "de", "la", "villa", "romaine", "histoire", "goths", "et", "francs", "étude", "12"]
    out = []
    for _ in range(60):
        t = " ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 7)))
        at = rnd.randrange(len(t))
        out += [t, t[:at] + rnd.choice("xyz ") + t[at + 1 :], t[:at] + t[at + 1 :], t + rnd.choice(["s", " i", ""])]
    return out


def test_no_near_pair_is_lost(spark, monkeypatch):
    """Cells and tiles of any size give the pairs of a comparison of all, each once, and rows of no common gram."""
    own = [(i, t, str(i % 2)) for i, t in enumerate(titles())]
    d = spark.createDataFrame(own, "id long, k string, block string").repartition(3)
    for tile in (16_000, 7):
        monkeypatch.setattr(R, "TILE", tile)
        for threshold in (0.9, 0.7):
            got = sorted((r.a, r.b) for r in R.like_pairs(d, threshold).collect())
            want = sorted((a, b) for a, x, p in own for b, y, q in own if a < b and p == q and indel_ratio(x, y) >= threshold)
            assert got == want
    left, right = [x for x in own if x[2] == "0"], [x for x in own if x[2] == "1"]
    sides = [spark.createDataFrame(x, "id long, k string, block string") for x in (left, right)]
    got = sorted((r.a, r.b) for r in R.like_between(*sides, 0.85).collect())
    all_ = sides[0].select(F.col("id").alias("a"), F.col("k").alias("x")).crossJoin(sides[1].select(F.col("id").alias("b"), F.col("k").alias("y")))
    assert got == sorted((r.a, r.b) for r in all_.where(R.native_ratio(F.col("x"), F.col("y")) >= 0.85).collect())


def test_shared_tokens_shuffle_no_pairs(spark, monkeypatch):
    """No more rows are shuffled than the tokens of both sides for each tile; counts are those of all pairs."""
    rnd = random.Random(2)
    rows = lambda n: [(i, w) for i in range(n) for w in rnd.choices("abcdefghijkl", k=5)]
    left, right = rows(60), [(f"r{i}", w) for i, w in rows(40)]
    l, r = spark.createDataFrame(left, "a long, token string"), spark.createDataFrame(right, "b string, token string")
    sets = lambda x: {i: {w for j, w in x if j == i} for i, _ in x}
    want = sorted((a, b, len(x & y)) for a, x in sets(left).items() for b, y in sets(right).items() if len(x & y) >= 2)
    for side in (8_000, 9):
        monkeypatch.setattr(O, "SIDE", side)
        d = O.shared_tokens(l, r)
        assert sorted(map(tuple, d.collect())) == want
        assert "Join" not in d._jdf.queryExecution().optimizedPlan().toString()
