"""Operators for corpus building against brute force, round trips and edge cases."""

from __future__ import annotations

import base64
import datetime
import random
from functools import lru_cache
from itertools import permutations
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import bpe, components, linkage, names, near_duplicates, ocr, packing, publications, queries, survivors, truncation
from tests.compare import check, duck

VOCABULARY = Path(f"{bpe.TOKENIZERS}/byte_bpe_50k.tiktoken")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, data, name):
    assert check(spark, duck(data), name, queries.QUERIES[name], queries.SQL[name], data) == ""


def closure(edges):
    root = {}

    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {(i, find(i)) for a, b in edges if a is not None and b is not None and a != b for i in (a, b)}


@pytest.mark.parametrize("method", [components.low_diameter, components.alternating_stars])
def test_groups(spark, method):
    rnd = random.Random(5)
    edges = [(rnd.randint(0, 60), rnd.randint(0, 60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 118)] + [(200, i) for i in range(201, 215)] + [(None, 3), (7, 7), (1, 2), (2, 1)]
    d = spark.createDataFrame(edges, "a long, b long")
    assert {tuple(r) for r in method(d).select("id", "group_id").collect()} == closure(edges)
    assert method(d.limit(0)).count() == 0


def test_survivors(spark):
    t = datetime.datetime
    rows = [(1, 1, "a", t(2024, 1, 1)), (2, 1, "b", t(2024, 2, 1)), (3, 1, None, t(2025, 1, 1)), (4, 4, None, None), (5, 5, "x", None), (6, 5, "y", None), (7, None, "z", None)]
    d = spark.createDataFrame(rows, "id long, group_id long, v string, date_modified timestamp").withColumn("best", F.lit("clash"))
    got = survivors.survive(d, {"v": F.col("v")})
    assert {tuple(r) for r in got.collect()} == {(1, "b"), (4, ""), (5, "x")}


def test_encoder_equals_public_library():
    import tiktoken

    raw = VOCABULARY.read_bytes()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    want = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    b = bpe.BytePairs(raw)
    rnd = random.Random(1)
    texts = ["", " ", "<|endoftext|> a", "a" * 5000, "é€人\n\n  x", "don't I'll"] + ["".join(rnd.choice("abcdeéth ing1\n€人 . ") for _ in range(rnd.randint(0, 60))) for _ in range(500)]
    for t in texts:
        ids = b.encode(t)
        assert ids == want.encode_ordinary(t) and b.decode(ids) == t


def test_encode_frame(spark):
    d = spark.createDataFrame([(1, None), (2, ""), (3, "<|endoftext|>"), (3, "a b")], "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = bpe.encode_texts(d).collect()
    assert sorted((r.doc_id, bool(r.ids)) for r in got) == [(1, False), (2, False), (3, True), (3, True)]
    assert bpe.encode_texts(d.limit(0)).count() == 0


def test_plan_packs_everything():
    rnd = random.Random(7)
    for _ in range(60):
        c = rnd.randint(5, 60)
        hist = {}
        for _ in range(rnd.randint(0, 40)):
            s = rnd.randint(1, c)
            hist[s] = hist.get(s, 0) + rnd.choice([1, 1, 2, 50])
        plan = packing.plan(hist, c)
        packed = {}
        for k, items in plan:
            assert k > 0 and sum(s * n for s, n in items) <= c
            for s, n in items:
                packed[s] = packed.get(s, 0) + k * n
        assert packed == hist


def test_reduction_is_optimal_on_small_instances():
    rnd = random.Random(8)

    def optimum(items, c):
        best = len(items)
        for order in set(permutations(items)):
            bins = []
            for s in order:
                for i, b in enumerate(bins):
                    if b + s <= c:
                        bins[i] += s
                        break
                else:
                    bins.append(s)
            best = min(best, len(bins))
        return best

    for _ in range(60):
        c, items = 20, [rnd.randint(4, 16) for _ in range(6)]
        hist = {s: items.count(s) for s in items}
        fixed, left = packing.reduce_dominated(dict(hist), c)
        rest = [s for s, n in left.items() for _ in range(n)]
        assert sum(k for k, _ in fixed) + (optimum(rest, c) if rest else 0) == optimum(items, c)


def test_pack_frame(spark):
    d = spark.createDataFrame([(1, "one two three " * 30), (2, None), (3, ""), (4, "a"), (4, "a"), (5, "x y " * 400)], "doc_id long, text string")
    k = spark.createDataFrame([(1, "byte_bpe_50k", 64), (2, "word_bpe_49k", 32), (3, "unknown", 10), (4, "piece_bpe_32k", 0)], "conteneur_id int, tokenizer string, capacite int")
    got = packing.pack(d, k).collect()
    assert {r.conteneur_id for r in got} == {1, 2}
    for kind, capacity in ((1, 64), (2, 32)):
        mine = [r for r in got if r.conteneur_id == kind]
        spans = {}
        for r in mine:
            assert r.position + r.end - r.start <= capacity
            if r.end > r.start:
                spans.setdefault(r.container, []).append((r.position, r.position + r.end - r.start))
        for s in spans.values():
            s.sort()
            assert all(a[1] == b[0] for a, b in zip(s, s[1:])) and s[0][0] == 0
        assert sum(r.end - r.start for r in mine if r.doc_id == 5) == max(r.end for r in mine if r.doc_id == 5)
    assert packing.pack(d, k.limit(0)).count() == 0 and packing.pack(d.limit(0), k).count() == 0


def test_truncation(spark):
    full = "The author returns to the old question of identity. "
    rows = [(i, full * 3, "s") for i in range(40)] + [(100, full + "The author returns to the", "s"), (101, full + "See also.\nKeywords: Goths, Huns", "s"), (102, "The Goths at Rome: a study", "s"), (103, None, "s"), (104, "  ", None), (105, full + "The author […]", None), (106, full + "\nA. Dupont", "s"), (107, full + "The author retu <em>", "s")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("kind", F.lit("clash"))
    j = truncation.judge(d)
    assert {r.doc_id for r in j.where("odds > 0").collect()} == {100, 105, 107}
    assert j.where("doc_id IN (103, 104)").count() == 0 and truncation.judge(d.limit(0)).count() == 0
    assert {(r.source, r.n_cut) for r in truncation.shares(j).collect()} == {("s", 2), (None, 1)}


def test_censored_fit_recovers_parameters():
    import math

    rnd = random.Random(9)
    lengths, cut = [], 0
    for _ in range(20000):
        x = rnd.lognormvariate(6.0, 0.8)
        if x > 600:
            cut += 1
        else:
            lengths.append(round(x))
    logs = [math.log(x) for x in lengths]
    mean, dev = truncation.censored_fit(len(logs), sum(logs), sum(x * x for x in logs), {600: cut})
    assert math.isclose(mean, 6.0, abs_tol=0.05) and math.isclose(dev, 0.8, abs_tol=0.05)


def truncated(spark, limit):
    """300 notices of source s, of which 60 are as long as `limit` and open; one title is 60 characters long."""
    rnd = random.Random(12)
    sentence = lambda: f"The {rnd.choice(['author', 'writer', 'critic'])} returns to the {rnd.choice(['old', 'new', 'open'])} question of identity. "
    rows = [(i, "".join(sentence() for _ in range(rnd.randint(1, 9))).strip()) for i in range(240)]
    rows += [(1000 + i, ("".join(sentence() for _ in range(6)) + "The author returns to the question of id")[-limit:]) for i in range(60)]
    rows += [(2000 + i, f"The rampart of {w}: law and land"[: limit + 20]) for i, w in enumerate(("Hastuttecourt", "Romeford", "Condirudun", "Belo", "Fotogueste"))]
    return spark.createDataFrame([(i, t, "s") for i, t in [*rows, (3000, "The author returns to the question of the old identity, whic")]], "doc_id long, text string, source string")


def test_truncation_follows_the_limit_of_a_source(spark):
    """The same text is cut where its length is its source's limit, and whole or doubtful elsewhere."""
    def odds(limit, fitted=True):
        return {r.doc_id: r.odds for r in truncation.judge(truncated(spark, limit), fitted=fitted).collect()}

    at, elsewhere, without = odds(60), odds(90), odds(60, False)
    assert at[3000] > elsewhere[3000] + 2 and at[3000] > without[3000] + 2
    assert at[3000] > 0 and all(at[2000 + i] < 0 for i in range(5)) and all(v == float("-inf") for k, v in at.items() if k < 1000)


def test_lengths_far_out_are_no_limits(spark):
    rnd = random.Random(2)
    hist = [("s", "bytes", 60000 + 7 * i, 1, 1) for i in range(900)] + [("s", "bytes", rnd.randint(100, 3000), 1, 0) for _ in range(400)]
    d = spark.createDataFrame(hist, "source string, unit string, size long, n long, n_open long")
    assert truncation.censoring_posteriors(d).count() == 0
    d = d.unionAll(spark.createDataFrame([("s", "bytes", 65535, 40, 38)], d.schema))
    assert [(r["size"], r.posterior > 0.9) for r in truncation.censoring_posteriors(d).collect()] == [(65535, True)]


def test_names():
    p = names.parse
    assert p("Dupont, Jean") == ("person", ["dupont"], ["jean"]) and p(None)[0] == "" and p("NA")[0] == "" and p("Collectif")[0] == ""
    assert p("A. Dupont; Jean Martin")[0] == "two" or p("Dupont, Jean & Martin, Paul")[0] == "two"
    assert p("Dupont, Jean & Martin, Paul")[0] == "two" and p("Dupont; Jean")[0] == "person"
    like = lambda a, b: names.alike(p(a), p(b), set())
    assert like("Dupontel, Jean", "Jean DUPONTEL") == "full" and like("Dupontel, J.", "Dupontel, Jean") == "initial" and like("Dupontel, Jean", "Dupontel, Paul") == ""
    assert like("Karlov, Robert", "Bob Karlov") == "full" and like("Карлов, Николай", "Karlov, Nikolai") == "full" and like("Dupnotel, Jean", "Dupontel, Jean") == "full"
    assert like("Academy of Aredonures Antiquities", "Acad. of Aredonures Antiq.") == "full" and like("Academy of Aredonures Antiquities", "Museo civico di Aredonures") == ""


def test_the_common_subsequence_decides(monkeypatch):
    """Words of one length with as many letters in place may be alike or not by the order of the rest."""
    assert names._typo("dupontel", "dupnotel") and names._typo("dupontel", "dupontl") and not names._typo("dupontel", "dupantil") and names._typo("dupontelier", "dupantelir")
    like = lambda: names.alike(names.parse("Dupontel, Jean"), names.parse("Dupnotel, Jean"), set())
    assert like() == "full"
    monkeypatch.setattr(names, "lcs_length", lambda a, b: 0)
    assert like() == ""


def test_abbreviated_organisations():
    assert names.parse("C. d'Ét. médiév. de Romeford")[0] == "org" == names.parse("Centre d'études médiévales de Romeford")[0]
    assert names.alike(names.parse("C. d'Ét. médiév. de Romeford"), names.parse("Centre d'études médiévales de Romeford"), set()) == "full"
    assert names.parse("Dupont, J.-Cl.")[0] == "person" and names.parse("A. Et. Martin")[0] == "open"


def test_hot_blocks_keep_variants(spark):
    """More forms under one family name and letter than a block may have: edits and initials are still found."""
    rnd = random.Random(21)
    given = sorted({"j" + "".join(rnd.choice("aeioulnrst") for _ in range(6)) for _ in range(70)})
    rows = [(i, "person", ["martinel"], [g]) for i, g in enumerate(given)] + [(500, "person", ["martnel"], [given[3]]), (501, "person", ["martinel"], ["j"]), (502, "person", ["martinel"], [given[5][:3] + given[5][4:]])]
    d = spark.createDataFrame(rows, f"form long, {names.FORM}")
    for common in (3, 1000):
        got = {(r.a, r.b, r.how) for r in names.similar_forms(d, common).collect()}
        assert {(3, 500, "full"), (3, 501, "initial"), (5, 502, "full")} <= got and sum(how == "initial" for _, _, how in got) >= len(given)


def test_people(spark):
    cols = "id long, NomComplet string, PPN_IDREF string, PPN_VIAF string, orcid string, isni string, bnf string"
    rows = [(1, "Dupontel, Jean", "026927608", None, None, None, None), (2, "Jean Dupontel", None, None, None, None, None), (3, "Martinov, A.", "26927608", None, None, None, None), (4, "Homonyme, Paul", "026927608", "11111111", None, None, None),
            (5, "Dupontel, Jean & Martin, Paul", None, None, None, None, None), (6, None, None, None, None, None, None), (7, "", None, None, None, None, None), (2, "Jean Dupontel", None, None, None, None, None)]
    got = {tuple(r) for r in names.pairs(names.people(spark.createDataFrame(rows, cols))).collect()}
    assert got == {(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4)}
    assert names.people(spark.createDataFrame([], cols)).count() == 0


def test_near_duplicates(spark):
    cols = "id long, title string, secondary_title string, year int, doi string, start_page string, volume string"
    base = [("The rampart of Hastuttecourt: a historiographical essay", "Acta Barbarica", 1999), ("Les Saxons à Condirudun : droit, terre et tribut", "Revue gothique", 2001), ("Introduction", "Acta Danubiana : Romeford", 1980), ("Introduction", "Revue du Nord", 1980)]
    rows = [(i + 1, *b, None, None, None) for i, b in enumerate(base)]
    rows += [(11, "<i>The rampart of Hastutecourt : a historiographical essay</i>", "Acta Barb.", 2000, None, None, None), (12, "LES SAXONS A CONDIRUDUN: DROIT, TERRE ET TRIBUT", None, None, None, None, None), (13, "The rampart of Hastuttecourt: a historiographical essay", "Acta Barbarica", 2009, None, None, None),
             (14, "[Introduction]", "Acta Danubiana : Romeford", 1980, None, None, None), (15, None, None, None, None, None, None), (16, "", "x", 1980, None, None, None), (17, "The rampart of Hastuttecourt: a historiographical essay, II", "Acta Barbarica", 1999, None, None, None)]
    rnd = random.Random(6)
    place = lambda: "".join(rnd.choice("bdfgklmnprst") + rnd.choice("aeiou") for _ in range(5))
    rows += [(50 + i, f"{place()} and {place()} in late sources", place(), 1950 + i, None, None, None) for i in range(20)]
    d = spark.createDataFrame(rows, cols).withColumn("words", F.lit("clash"))
    got = {tuple(r) for r in near_duplicates.pairs_of(near_duplicates.groups(d)).collect()}
    assert got == {(1, 11), (2, 12), (3, 14)}
    assert near_duplicates.groups(d.limit(0)).count() == 0


def test_signatures_decide(spark):
    cols = "id long, title string, secondary_title string, year int, doi string, start_page string, volume string"
    rnd = random.Random(6)
    place = lambda: "".join(rnd.choice("bdfgklmnprst") + rnd.choice("aeiou") for _ in range(5))
    rows = [(50 + i, f"{place()} and {place()} in late sources", place(), 1950 + i, None, None, None) for i in range(20)]
    rows += [(1, "The rampart of Hastuttecourt: a historiographical essay", "Acta Barbarica", 1999, None, None, None), (2, "The rampart of Hastutecourt: a historiographical esay", "Acta Barbarica", 1999, None, None, None)]
    d = spark.createDataFrame(rows, cols)
    found = lambda like: {(r.a, r.b) for r in near_duplicates.matches(d, like)[1].collect()}
    assert found(near_duplicates.LIKE) == {(1, 2)} and found(1.01) == set()


def test_hot_bands_lose_no_pair(spark):
    rnd = random.Random(11)
    rows = [(i, rnd.randint(1, 3), 7, rnd.choice([None, 1990, 1991, 1992, 1995]), rnd.choice(["", "1", "2"]), rnd.choice(["", "1", "2"]), rnd.choice(["", "", "", "10.1/a", "10.1/b"])) for i in range(120)]
    d = spark.createDataFrame(rows, "id long, band long, must long, year int, page string, volume string, doi string")
    got = {hot: {tuple(r) for r in near_duplicates.met(d, hot).collect()} for hot in (2, 1000)}
    assert got[2] == got[1000] and len(got[2]) > 100


def test_titles():
    w, n, review = publications.title_of("Compte rendu de : The Goths of Rome, II [texte imprimé]")
    assert review and n == "2" and w[:2] == ["the", "goths"]
    assert publications.title_likeness(["gothi", "romani"], ["romani", "gothi"]) == (1.0, 1.0)
    assert publications.host_likeness(publications.host_of("Ann. de protohistoire"), publications.host_of("Annales de protohistoire")) == 1.0


def total(left, right, w):
    """The largest total of an assignment, by trying all."""
    ls, rs = [a for a, n in left.items() for _ in range(n)], [b for b, n in right.items() for _ in range(n)]

    @lru_cache(None)
    def go(i, used):
        if i == len(ls):
            return 0.0
        return max([go(i + 1, used)] + [w[ls[i], rs[j]] + go(i + 1, used | 1 << j) for j in range(len(rs)) if not used >> j & 1 and (ls[i], rs[j]) in w])

    return go(0, 0)


def test_assignment_is_best():
    rnd = random.Random(3)
    for _ in range(400):
        left, right = {f"l{i}": rnd.choice([1, 1, 1, 2, 3]) for i in range(rnd.randint(1, 4))}, {f"r{i}": rnd.choice([1, 1, 2]) for i in range(rnd.randint(1, 4))}
        w = {(a, b): round(rnd.choice([rnd.random(), 0.5, 0.7]), 3) + 0.01 for a in left for b in right if rnd.random() < 0.7}
        got = linkage.best_assignment(w, left, right)
        assert all(sum(k for p, k in got.items() if p[0] == a) <= n for a, n in left.items()) and all(sum(k for p, k in got.items() if p[1] == b) <= n for b, n in right.items())
        assert abs(sum(w[p] * k for p, k in got.items()) - total(left, right, w)) < 1e-6


def test_assignment_of_a_large_component():
    rnd = random.Random(4)
    w = {(f"l{i}", f"r{(i + j) % 5000}"): round(0.9 + 0.00001 * rnd.randrange(5), 6) for i in range(5000) for j in range(10)}
    got = linkage.best_assignment(w)
    assert len(w) == 50000 and len(got) == 5000 and set(got.values()) == {1} and len({a for a, _ in got}) == 5000 == len({b for _, b in got})


def test_copies_are_assigned_as_a_class(spark):
    e = spark.createDataFrame([("a", "x", 0.9, 3, 2), ("a", "y", 0.8, 3, 1), ("b", "x", 0.7, 1, 2)], "l string, r string, confidence double, nl long, nr long")
    made = linkage.assign(e)
    assert {tuple(r) for r in made.collect()} == {("a", "x", 0.9, 2), ("a", "y", 0.8, 1)}
    members = spark.createDataFrame([(0, "a", "a"), (0, "a2", "a"), (0, "a3", "a"), (0, "b", "b"), (1, "x", "x"), (1, "x2", "x"), (1, "y", "y")], "src int, id string, rep string")
    assert {tuple(r) for r in linkage.expand(made, members).collect()} == {("a", "x", 0.9), ("a2", "x2", 0.9), ("a3", "y", 0.8)}


def test_linkage_empty(spark):
    ref = spark.createDataFrame([(1, "The rampart of Hastuttecourt", "Acta", 1999)], "id long, title string, secondary_title string, year int")
    e = spark.createDataFrame([], "reference_id long, author_id long")
    a = spark.createDataFrame([], "id long, NomComplet string")
    items = spark.createDataFrame([("x", "The rampart of Hastutecourt", "Acta", None, [], "1999-01-0"), ("y", None, None, None, None, None)], "item_id string, title string, is_part_of string, creators_string string, creators array<struct<first_name:string,last_name:string,order:int>>, published_date string")
    assert [tuple(r)[:2] for r in linkage.link(ref, e, a, items).collect()] == [(1, "x")]
    assert linkage.link(ref.limit(0), e, a, items).count() == 0


def corpus(spark, docs):
    return spark.createDataFrame([(i, t, None if x is None else [(w, w.lower() if w else None, None) for w in x]) for i, t, x in docs], "doc_id string, title string, lexical_features array<struct<token:string,lemma:string,pos:string>>")


def test_ocr(spark):
    s = "The author returns to the question of identity which earlier scholarship treated as a matter of blood .".split()
    docs = [(str(i), "A title", s * 4) for i in range(12)]
    bad = "— 12 — The author retums to the quest- ion of identitywhich earlier schol arship treated as a matter of blood .".split()
    d = corpus(spark, [*docs, ("x", "A title", bad), ("n", None, None), ("e", None, []), ("v", "A title", [None, "The", None])])
    got = {(r.doc_id, r.idx) for r in ocr.repairs(d).collect()}
    assert got == {("x", i) for i in (0, 1, 2, bad.index("retums"), bad.index("quest-"), bad.index("ion"), bad.index("identitywhich"), bad.index("schol"), bad.index("arship"))}
    text = {r.doc_id: r.text for r in ocr.continuous(d, ocr.repairs(d)).collect()}
    assert text["x"] == "The author returns to the question of identity which earlier scholarship treated as a matter of blood."
    assert ocr.repairs(d.limit(0)).count() == 0


def test_neighbours_pick_the_word(spark):
    """`hcad` may be head or bead: what stands around decides, whatever is more frequent."""
    docs = [(str(i), None, "he turned his head away . a glass bead was found .".split() * 5) for i in range(12)] + [(f"m{i}", None, "one more head then .".split() * 40) for i in range(3)]
    d = corpus(spark, [*docs, ("x", None, "a glass bcad was found . he turned his hcad away .".split())])
    types = spark.createDataFrame([("bcad", 1), ("head", 180), ("bead", 60)], "token string, n long")
    picked = spark.createDataFrame([("bcad", "head", 1, 4.0), ("bcad", "bead", 1, 3.0)], "token string, word string, n long, score double")
    bigrams = spark.createDataFrame([("glass", "bead", 60), ("bead", "was", 60), ("his", "head", 60), ("glass", "bcad", 1), ("bcad", "was", 1)], "a string, b string, n long")
    place = spark.createDataFrame([("glass", "bcad", "was")], "before string, token string, after string")
    assert types.count() == 3
    assert [r.repair for r in ocr.chosen_words(place, picked, bigrams).collect()] == ["bead"]
    assert [r.repair for r in ocr.chosen_words(place, picked, bigrams, context=False).collect()] == ["head"]
    fixed = {r.idx: r.repair for r in ocr.repairs(d).where("doc_id = 'x'").collect()}
    assert fixed == {2: "bead", 9: "head"}


def test_one_repair_of_an_element(spark):
    s = "many places where inscriptions were found by the excavators .".split()
    d = corpus(spark, [*[(str(i), None, s * 6) for i in range(12)], ("x", None, "many plac es where inscriptions were found by the excavators .".split())])
    got = {(r.idx, r.kind, r.repair) for r in ocr.repairs(d).where("doc_id = 'x'").collect()}
    assert got == {(1, "split", "places"), (2, "split", None)}
    text = {r.doc_id: r.text for r in ocr.continuous(d, ocr.repairs(d)).collect()}
    assert text["x"] == " ".join(s[:-1]) + "." and text["0"].count("\n\n") == 0
    assert ocr.paragraphs(["The", "end", ".", '"', "So", '"', "he", "said", ".", "It", "’s", "(", "not", ")", "."], 1) == ["The end.", '"So" he said.', "It’s (not)."]


def test_strokes(spark):
    d = spark.createDataFrame([(x, y) for x, y in ocr.CONFUSIONS if "nn" not in (x, y)], "x string, y string")
    assert d.where(ocr._strokes(F.col("x")) != ocr._strokes(F.col("y"))).count() == 0


def test_edit_distance():
    assert ocr.edit_distance("the", "tbe", 1.3) == pytest.approx(0.3) and ocr.edit_distance("modern", "modem", 1.3) == pytest.approx(0.3) and ocr.edit_distance("abc", "xyz", 1.0) == 2.0


def test_all_queries_run(spark, data):
    for q in queries.QUERIES.values():
        q(spark, data).write.format("noop").mode("overwrite").save()
