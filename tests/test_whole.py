"""Registered queries over small fixtures, where less than the whole job gives other results."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pytest

from palimpsest.functions.similarity import indel_ratio
from palimpsest.operators import graph as G
from palimpsest.operators import models as M
from palimpsest.operators import resolve as R
from palimpsest.plans import corpus, entities


@pytest.fixture(scope="module")
def two_cliques():
    """Edges of two cliques, alike in size, with a chain between them and vertices that hang on."""
    e = {(a, b): 1 for a, b in combinations(range(1, 8), 2)} | {(a, b): 1 for a, b in combinations(range(21, 27), 2)}
    e |= {(7, 10): 1, (10, 11): 2, (11, 12): 1, (12, 21): 1, (26, 30): 2, (26, 31): 1, (2, 32): 1, (40, 41): 3}
    return sorted((u, v, w) for (u, v), w in e.items())


def dense(edges, weighted):
    ids = sorted({x for u, v, _ in edges for x in (u, v)})
    a = np.zeros((len(ids), len(ids)))
    for u, v, w in edges:
        i, j = ids.index(u), ids.index(v)
        a[i, j] = a[j, i] = w if weighted else 1
    return ids, a


def test_eigenvector_is_the_dense_one(spark, monkeypatch, two_cliques):
    monkeypatch.setattr(corpus, "coauthors", lambda s, d: s.createDataFrame(two_cliques, "u bigint, v bigint, weight bigint"))
    ids, a = dense(two_cliques, True)
    x = np.abs(np.linalg.eigh(a)[1][:, -1])
    got = {r.id: r.eigenvector for r in corpus.eigenvector(spark, "").collect()}
    assert got.keys() == set(ids)
    assert max(abs(got[i] - y) for i, y in zip(ids, x)) < 6e-6
    assert {r.eigenvector for r in G.eigenvector(corpus.coauthors(spark, ""), 10).collect()} == {0.0}  # not settled


def test_katz_is_the_dense_one(spark, monkeypatch, two_cliques):
    monkeypatch.setattr(corpus, "coauthors", lambda s, d: s.createDataFrame(two_cliques, "u bigint, v bigint, weight bigint"))
    ids, a = dense(two_cliques, False)
    top = np.linalg.eigvalsh(a)[-1]
    assert abs(G.leading_eigenvalue(corpus.coauthors(spark, "")) - top) < 1e-6
    x = np.linalg.solve(np.eye(len(ids)) - 0.85 / top * a, np.ones(len(ids)))
    got = {r.id: r.katz for r in corpus.katz(spark, "").collect()}
    assert got.keys() == set(ids)
    assert max(abs(got[i] - y) for i, y in zip(ids, x / np.linalg.norm(x))) < 6e-6
    assert {r.katz for r in G.katz(corpus.coauthors(spark, ""), rounds=10).collect()} == {0.0}  # not settled


def test_diameter_of_the_largest_component(spark, monkeypatch, two_cliques):
    monkeypatch.setattr(corpus, "coauthors", lambda s, d: s.createDataFrame(two_cliques, "u bigint, v bigint, weight bigint"))
    assert tuple(corpus.lcc_diameter(spark, "").first()) == (19, 8)  # 32 or 6, 2, 7, 10, 11, 12, 21, 26, 30


def test_centralities_of_no_edges(spark):
    d = spark.createDataFrame([], "u bigint, v bigint, weight bigint")
    assert G.eigenvector(d).count() == 0 and G.katz(d).count() == 0


def test_topics_come_from_all_documents(spark):
    themes = [["grain", "plough", "field", "mill"], ["ship", "sail", "harbour", "mast"]]
    docs = spark.createDataFrame([(i, themes[i % 2] * 5) for i in range(16)], "doc_id bigint, terms array<string>")
    model, vocabulary, gamma = M.lda(docs, "doc_id", "terms", 2)
    got = {}
    for r in M.topic_words(model, vocabulary, 4).collect():
        got.setdefault(r.topic, {})[r.term] = r.beta
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, themes))
    assert all(sum(t.values()) > 0.95 for t in got.values())
    assert all(max(r.gamma) > 0.9 for r in gamma.collect())


@pytest.mark.parametrize(("name", "passes"), [("lda_topics", 30), ("topic_coherence", 20), ("yearly_presence", 30)])
def test_topic_queries_make_the_passes_of_the_reference(spark, data, monkeypatch, name, passes):
    from pyspark.ml.clustering import LDA

    seen = []
    fit = LDA._fit
    monkeypatch.setattr(LDA, "_fit", lambda self, d: seen.append(self.getMaxIter() * self.getSubsamplingRate()) or fit(self, d))
    getattr(corpus, name)(spark, data)
    assert seen == [passes]


def test_coherence_with_a_word_in_every_window(spark):
    tokens = spark.createDataFrame([(d, i, w) for d in range(6) for i, w in enumerate(["the", "ship", "sail"] if d < 3 else ["the", "mill"])], "doc_id bigint, at int, token string")
    topics = spark.createDataFrame([(0, "the"), (0, "ship"), (0, "sail")], "topic int, term string")
    # the vectors (1, 0, 0), (0, 1, 1), (0, 1, 1) against their sum
    assert abs(M.coherence(tokens, "doc_id", topics).first().c_v - (1 / 3 + 2 * 4 / (3 * 2**0.5)) / 3) < 1e-9


def test_like_hosts_may_begin_otherwise(spark, monkeypatch):
    hosts = ["handbook of ancient mills", "the handbook of ancient mills", "hndbook of ancient mills", "ships of the north"]
    rows = [(i, "Chapter 3 The mills of the valley", h) for i, h in enumerate(hosts, 1)]
    monkeypatch.setattr(entities, "table", lambda s, d, n: s.createDataFrame(rows, "id bigint, title string, secondary_title string"))
    got = entities.chapter_clusters(spark, "").collect()
    assert {r.id for r in got} == {1, 2, 3}


def strings(rnd, n):
    bases = ["".join(rnd.choices("abcde ", k=rnd.randint(3, 14))).strip() or "a" for _ in range(12)]
    out = []
    for _ in range(n):
        k = list(rnd.choice(bases))
        for _ in range(rnd.randint(0, 3)):
            k[rnd.randrange(len(k))] = rnd.choice(["", "x", "ab"])
        out.append("".join(k).strip() or "b")
    return out


@pytest.mark.parametrize("block", [None, "block"])
def test_leaders_are_those_of_the_sequential_rule(spark, block):
    import random

    rnd = random.Random(5)
    rows = [(i, k, str(rnd.randint(0, 2))) for i, k in enumerate(strings(rnd, 160), 1)]
    want, leaders = set(), {}
    for i, k, b in rows:
        known = leaders.setdefault(b if block else "", [])
        hit = next((l for l, x in known if indel_ratio(k, x) >= 0.8), None)
        if hit is None:
            known.append((i, k))
        want.add((i, i if hit is None else hit))
    d = spark.createDataFrame(rows, "id bigint, k string, block string")
    assert {tuple(r) for r in R.greedy_leaders(d, block, "k", 0.8).collect()} == want


def test_like_pairs_lose_none(spark):
    import random

    rnd = random.Random(7)
    rows = [(i, k, str(i % 2)) for i, k in enumerate(strings(rnd, 120))]
    got = {(r.a, r.b) for r in R.like_pairs(spark.createDataFrame(rows, "id bigint, k string, block string"), 0.75).collect()}
    assert got == {(i, j) for (i, x, b), (j, y, c) in combinations(rows, 2) if b == c and indel_ratio(x, y) >= 0.75} and len(got) > 100


def test_aggressive_is_the_sequential_rule(spark):
    import random

    rnd = random.Random(8)
    rows = [(i, rnd.choice([None, 1990, 1991]), t, rnd.choice([None, "", "h", "g"])) for i, t in enumerate(strings(rnd, 150))]

    def settle(part, kept):
        out = []
        for i, _, t, h in sorted(part, key=lambda r: (len(r[2]), r[0])):
            if not any((not h or not x or h == x) and indel_ratio(t, k) >= 0.8 for _, k, x in kept):
                kept.append((i, t, h))
                out.append(i)
        return out

    stay, dated = set(), []
    for y in (1990, 1991):
        kept = []
        stay |= set(settle([r for r in rows if r[1] == y], kept))
        dated += kept
    mine = []
    settle([r for r in rows if r[1] is None], mine)
    stay |= {i for i, t, h in mine if not any((not h or not x or h == x) and indel_ratio(t, k) >= 0.8 for _, k, x in dated)}
    d = spark.createDataFrame(rows, "id bigint, year int, title string, host string")
    assert {r.id for r in R.aggressive(d, 0.8).where("kept").collect()} == stay


def test_authors_enter_the_largest_component_in_a_year(spark, monkeypatch):
    pairs = [(1, 2, 1975), (2, 3, 1983), (3, 4, 1987), (10, 11, 1988), (11, 12, 1988), (12, 13, 1988), (13, 14, 1988), (1, 5, 1989), (5, 6, 1989)]
    monkeypatch.setattr(corpus, "_dated_pairs", lambda s, d: s.createDataFrame([(*p, 1) for p in pairs], "u bigint, v bigint, year bigint, weight int"))
    got = {r.id: r.year for r in corpus.lcc_entry_years(spark, "").collect()}
    assert got == {1: 1983, 2: 1983, 3: 1983, 4: 1987, 5: 1989, 6: 1989, **dict.fromkeys(range(10, 15), 1988)}
    got = {r.id: r.year for r in corpus.lcc_entry_years(spark, "", 1984, 5).collect()}
    assert got == {**dict.fromkeys(range(10, 15), 1988), **dict.fromkeys(range(1, 7), 1989)}
