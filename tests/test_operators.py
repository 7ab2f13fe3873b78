"""Operators against slow versions, and their edge cases."""

from __future__ import annotations

import datetime
import math
import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import identifiers as I
from palimpsest.functions import text as T
from palimpsest.functions.similarity import indel_ratio, lcs_length, osa
from palimpsest.functions.special import beta_lower, gamma_upper
from palimpsest.operators import graph as G
from palimpsest.operators import models as M
from palimpsest.operators import orphans as P
from palimpsest.operators import resolve as R
from palimpsest.operators import tabular as O


def slow_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_lcs_and_ratio():
    rnd = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rnd.choice("abcé ") for _ in range(rnd.randint(0, 14))) for _ in range(2))
        assert lcs_length(a, b) == slow_lcs(a, b)
        assert 0 <= indel_ratio(a, b) == indel_ratio(b, a) <= 1
    assert indel_ratio(None, "a") == 0 and osa("abcd", "abdc", 2) == 1 and osa("abc", "xyz", 1) == 2


def test_bounds_lose_no_pair(spark):
    rnd = random.Random(2)
    words = ["".join(rnd.choice("abc") for _ in range(rnd.randint(1, 9))) for _ in range(60)]
    d = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "id long, w string").withColumn("block", F.lit("x"))
    got = {(r.a, r.b) for r in R.similar_pairs(O.block_pairs(d, "id", "block", "w"), "x_w", "y_w", 0.8).collect()}
    assert got == {(i, j) for i, j in combinations(range(60), 2) if indel_ratio(words[i], words[j]) >= 0.8}


def test_identifiers(spark):
    ok = [("026927608", "026927608"), ("idref:026927608", "026927608"), ("26927608", "026927608"), ("026 927 608", "026927608"), ("026927608.0", "026927608"), ("026927609", None), ("000000000", None), ("0269?7608", None), (None, None), ("nan", None)]
    d = spark.createDataFrame(ok, "raw string, want string")
    assert d.where(~I.ppn(F.col("raw")).eqNullSafe(F.col("want"))).count() == 0
    ok = [("0000-0002-1825-0097", "0000-0002-1825-0097"), ("orcid:0000000218250097", "0000-0002-1825-0097"), ("0000-0002-1825-0098", None), ("0000–0002–1694–233x", "0000-0002-1694-233X"), ("", None), (None, None)]
    d = spark.createDataFrame(ok, "raw string, want string")
    assert d.where(~I.orcid(F.col("raw")).eqNullSafe(F.col("want"))).count() == 0
    d = spark.createDataFrame([("viaf/12345678/", "12345678"), ("12345678.0", "12345678"), ("000", None), ("VIAF 123456", "123456")], "raw string, want string")
    assert d.where(~I.viaf(F.col("raw")).eqNullSafe(F.col("want"))).count() == 0


def test_keys_are_those_of_a_slow_version(spark):
    import re
    import unicodedata

    def strip(t, form):
        return "".join(x for x in unicodedata.normalize(form, t) if not unicodedata.combining(x))

    def plain(t):
        return re.sub(r"[\s\u00a0]+", " ", re.sub(r"[^\w\s]", " ", t)).strip()

    rnd = random.Random(6)
    texts = ["".join(rnd.choice("aÉôßñΆλйx_ 1-’.,ﬁ") for _ in range(rnd.randint(0, 14))) for _ in range(150)]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    c = F.col("t")
    for r in d.select("t", T.name_key(c).alias("name"), T.reference_key(c).alias("ref"), T.ascii_key(c).alias("asc"), T.strict_ascii_key(c).alias("strict")).collect():
        ascii_ = strip(r.t, "NFKD").encode("ascii", "ignore").decode().lower()
        assert r.name == plain(strip(r.t.lower(), "NFD")) and r.ref == plain(strip(r.t, "NFKD").lower())
        assert r.asc == plain(ascii_) and r.strict == re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\s]", " ", ascii_)).strip()


def test_text(spark):
    d = spark.createDataFrame([("Éric  D'Ôo, (x)_1",)], "t string")
    c = F.col("t")
    r = d.select(T.name_key(c), T.ascii_key(c), T.strict_ascii_key(c), T.accented_key(c)).first()
    assert tuple(r) == ("eric d oo x _1", "eric d oo x _1", "eric d oo x 1", "éric d ôo x _1")
    one = lambda f, v: spark.createDataFrame([(v,)], "t string").select(f(F.col("t")).alias("r")).first().r
    assert one(T.clean_title, "[A title] more") == "A title more" and one(T.clean_title, ". a") == "a" and one(T.clean_title, None) == ""
    assert one(T.extract_doi, "see doi: 10.1234/ab.c") == "10.1234/ab.c" and one(T.extract_doi, "none") is None
    assert one(lambda c: T.entities(c, True), "Bego&#241a") == "Begoña"
    assert one(T.language_code, "French") == "fr" and one(T.language_code, "xx") is None
    assert one(T.script, "Гулмочорд") == "ru" and one(T.to_latin, "Лев") == "lev"
    assert one(lambda c: T.chapter_number(T.ascii_key(c)), "Chapter 7 The Goths") == 7
    assert one(T.clean_markup, "a <i>b</i> &amp; c") == "a b & c"


def test_orphans_incremental_equals_whole(spark):
    rnd = random.Random(3)
    day = lambda n: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=n)
    links = [(i, "f", "t", rnd.choice([None, *range(12)]), rnd.choice([None, day(rnd.randint(0, 90))])) for i in range(200)]
    parents = [("t", k, rnd.choice([None, day(rnd.randint(0, 90))])) for k in range(0, 12, 2)]
    gone = [("t", k, day(40)) for k in (1, 3, 3)]
    L = spark.createDataFrame(links, "id long, field string, target string, key long, at timestamp").where("key IS NOT NULL")
    A = spark.createDataFrame(parents, "target string, key long, added timestamp")
    D = spark.createDataFrame(gone, "target string, key long, removed_at timestamp")
    got = {}
    for cuts in ([], [day(30)], [day(20), day(50), day(70)]):
        s = P.replay(spark, P.increments(L, A, D, cuts))
        got[len(cuts)] = {(r.id, r.state) for r in P.orphans(s).collect()}
    have = {k: a for _, k, a in parents}
    want = set()
    for i, _, _, k, at in links:
        if k is None:
            continue
        if k in have:
            if have[k] and at and have[k] > at:
                want.add((i, "late"))
        else:
            want.add((i, "deleted" if k in (1, 3) else "missing"))
    assert got[0] == got[1] == got[3] == want


def test_orphans_reopen_and_resolve(spark):
    t = datetime.datetime(2024, 1, 1)
    none = lambda s: spark.createDataFrame([], s)
    L = spark.createDataFrame([(1, "t", "f", 5, t)], "id long, target string, field string, key long, at timestamp")
    A = spark.createDataFrame([("t", 5, t)], "target string, key long, added timestamp")
    D = spark.createDataFrame([("t", 5)], "target string, key long")
    s = P.advance(P.empty_state(spark), L, none(A.schema), none(D.schema))
    assert [r.state for r in P.orphans(s).collect()] == ["missing"]
    s = P.advance(s, none(L.schema), A, none(D.schema))
    assert P.orphans(s).count() == 0
    s = P.advance(s, none(L.schema), none(A.schema), D)
    assert [r.state for r in P.orphans(s).collect()] == ["deleted"] and P.snapshot(s).first().n == 1


def random_graph(n, m, seed):
    rnd = random.Random(seed)
    return sorted({tuple(sorted(rnd.sample(range(n), 2))) for _ in range(m)})


def test_components_and_paths(spark):
    e = random_graph(30, 28, 4)
    d = spark.createDataFrame([(u, v, 1) for u, v in e], "u long, v long, weight long")
    root = {}

    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    for u, v in e:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    ids = {x for p in e for x in p}
    assert {(r.id, r.component) for r in G.components(d).collect()} == {(i, find(i)) for i in ids}

    near = {i: set() for i in ids}
    for u, v in e:
        near[u].add(v)
        near[v].add(u)

    def bfs(s):
        dist, count, q = {s: 0}, {s: 1}, [s]
        for x in q:
            for y in near[x]:
                if y not in dist:
                    dist[y], count[y] = dist[x] + 1, 0
                    q.append(y)
                if dist[y] == dist[x] + 1:
                    count[y] += count[x]
        return dist, count

    all_ = {s: bfs(s) for s in ids}
    n = len(ids)
    want = {}
    for x in ids:
        b = 0.0
        for s, t in combinations(sorted(ids - {x}), 2):
            ds, cs = all_[s]
            if t in ds and x in ds and x in all_[t][0] and ds[x] + all_[t][0][x] == ds[t]:
                b += cs[x] * all_[t][1][x] / cs[t]
        want[x] = 2 * b / ((n - 1) * (n - 2))
    got = {r.id: r for r in G.path_centralities(d).collect()}
    for x in ids:
        dist = all_[x][0]
        assert math.isclose(got[x].betweenness, want[x], abs_tol=1e-9)
        assert got[x].eccentricity == max(dist.values())
        assert math.isclose(got[x].closeness, (len(dist) - 1) / sum(dist.values()) * (len(dist) - 1) / (n - 1))
    assert math.isclose(sum(r.pagerank for r in G.pagerank(d).collect()), 1.0, abs_tol=1e-3)


def test_empty_graph(spark):
    d = spark.createDataFrame([], "u long, v long, weight long")
    assert G.components(d).count() == 0 and G.clustering(d).count() == 0 and G.pagerank(d).count() == 0


def test_breaks():
    v = [1.0, 2, 3, 10, 11, 12, 30, 31]
    assert M.natural_breaks(v, 3) == [2, 5, 7]
    assert M.change_points([0.0, 0.1, 0, 0.1, 0, 0.1, 5, 5.1, 5, 5.1, 5, 5.1], 3.0) == [6]
    assert M.ward_labels([[0], [0.1], [5], [5.1]], 2) == [0, 0, 1, 1]


def test_special():
    assert math.isclose(gamma_upper(0.5, 1.920729), 0.05, abs_tol=1e-4)  # chi-squared, one degree
    assert math.isclose(gamma_upper(2, 3), math.exp(-3) * 4, rel_tol=1e-9)
    assert math.isclose(beta_lower(2, 3, 0.4), 0.5248, abs_tol=1e-4)


def test_decisions(spark):
    d = spark.createDataFrame([(1, 10, "keep"), (1, 11, "delete"), (2, 20, "keep"), (2, 21, "skip"), (3, 30, "delete")], "group_id long, member long, action string")
    m = R.valid_decisions(d)
    assert [tuple(r) for r in m.collect()] == [(1, 10, 11)]
    links = spark.createDataFrame([(7, 11), (7, 10), (8, 20)], "ref long, author long")
    once = R.relink(links, "ref", "author", m)
    assert {tuple(r) for r in once.collect()} == {(7, 10), (8, 20)} == {tuple(r) for r in R.relink(once, "ref", "author", m).collect()}


def test_shares_sum_to_one(spark, data):
    from palimpsest import plans

    s = plans.queries()["yearly_share_topn"](spark, data).groupBy("y").agg(F.sum("share").alias("s")).collect()
    assert s and all(abs(r.s - 1) < 1e-4 for r in s)


def test_conform(spark):
    d = spark.createDataFrame([(" 1 ", "NA"), ("x", " b ")], "` Id` string, `NAME` string")
    r = O.conform(d, {"id": "int", "name": "string", "extra": "int"}, ("id",)).collect()
    assert [tuple(x) for x in r] == [(1, None, None), (None, "b", None)]
    with pytest.raises(ValueError):
        O.conform(d, {"id": "int"}, ("missing",))


def test_readers_and_sinks(spark, tmp_path):
    from palimpsest.sources import readers, sinks

    (tmp_path / "a.jsonl").write_text('{"id": 1, "t": "x"}\nnot json\n{"id": 2, "t": "y"}\n')
    assert readers.json_lines(spark, str(tmp_path / "a.jsonl"), "id long, t string").where("id IS NOT NULL").count() == 2
    fields = "200 " + "\x1faDupont\x1fbJean\x1e"
    directory = "200" + f"{len(fields.encode()):04d}" + "00000"
    leader = f"{24 + len(directory) + 1 + len(fields.encode()) + 1:05d}nx   22" + f"{24 + len(directory) + 1:05d}" + "   450 "
    (tmp_path / "b.mrc").write_bytes((leader + directory + "\x1e" + fields + "\x1d").encode())
    r = readers.marc_records(spark, str(tmp_path / "b.mrc")).select(readers.marc_fields(F.col("record")).alias("f")).select(readers.person(F.col("f")["200"][0]).alias("p")).first()
    assert r.p == "Dupont Jean"
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id long, v string")
    assert {tuple(x) for x in sinks.upsert(old, new, ["id"]).collect()} == {(1, "a"), (2, "c"), (3, "d")}
    assert {tuple(x) for x in sinks.insert_ignore(old, new, ["id"]).collect()} == {(1, "a"), (2, "b"), (3, "d")}
    assert "a\\_b" in sinks.latex(["a_b"], [(1,)])


def test_feed_resumes(spark, tmp_path):
    from palimpsest.streaming import feeds

    src, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    src.mkdir()
    (src / "1.json").write_text('{"k": 1}\n{"k": 2}\n{"k": 1}\n')
    run = lambda: feeds.once_each(feeds.lines(spark, str(src), "k long"), "k", lambda d: d.withColumn("v", F.col("k") * 2), out, check).awaitTermination(60)
    run()
    (src / "2.json").write_text('{"k": 2}\n{"k": 3}\n')
    run()
    assert sorted(tuple(r) for r in spark.read.parquet(out).select("k", "v").collect()) == [(1, 2), (2, 4), (3, 6)]


def test_orphan_history(spark):
    """An arrival resolves a link that waits, a removal reopens it, a return resolves it again; the counts of every
    increment stay as they were, compacted or not."""
    t = datetime.datetime
    L = spark.createDataFrame([(1, "p", "f", 7, t(2024, 1, 5)), (2, "p", "f", 8, t(2024, 1, 6))], "id long, target string, field string, key long, at timestamp")
    A = spark.createDataFrame([("p", 7, None)], "target string, key long, added timestamp")
    D = A.select("target", "key")
    none = lambda d: d.limit(0)
    steps = [(L, none(A), none(D)), (none(L), A, none(D)), (none(L), none(A), D), (none(L), A, none(D))]
    want = {(1, "missing", 2), (2, "missing", 1), (3, "missing", 1), (3, "deleted", 1), (4, "missing", 1)}
    for every in (2, 9):
        s = P.replay(spark, steps, every=every)
        assert {(r.seq, r.state, r.n) for r in P.history(s).collect()} == want
        assert {(r.id, r.state) for r in P.orphans(s).collect()} == {(2, "missing")}


def test_orphan_feed_repeats_a_batch(spark, tmp_path, monkeypatch):
    from palimpsest.streaming import feeds

    folder, schema = tmp_path / "in", "id long, author_id long, date_added timestamp"
    folder.mkdir()
    (folder / "a.json").write_text('{"id": 1, "author_id": 7, "date_added": "2024-01-05T00:00:00"}\n')
    arrivals = [[("authors", 9, None)], [("authors", 7, None)], [("authors", 8, None)]]
    asked = []

    def parents():
        came = spark.createDataFrame(arrivals[len(asked)], "target string, key long, added timestamp")
        asked.append(1)
        return came, came.select("target", "key").limit(0)

    def run():
        feeds.orphan_feed(feeds.lines(spark, str(folder), schema), {"author_id": "authors"}, parents, str(tmp_path / "store"), str(tmp_path / "at")).awaitTermination()

    run()
    (folder / "b.json").write_text('{"id": 2, "author_id": 8, "date_added": "2024-01-06T00:00:00"}\n')
    whole = feeds.snapshot
    monkeypatch.setattr(feeds, "snapshot", lambda s: 1 / 0)  # the second batch fails behind its parents
    with pytest.raises(Exception, match="division"):
        run()
    monkeypatch.setattr(feeds, "snapshot", whole)
    run()
    links = spark.read.parquet(*[str(tmp_path / "store" / str(i) / "links") for i in (0, 1)])
    assert len(asked) == 2 and {(r.id, r.state, r.seq) for r in links.collect()} == {(1, "missing", 1), (1, "ok", 2), (2, "missing", 2)}
