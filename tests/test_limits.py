"""Sizes of plans, and files that are left on the disks."""

from __future__ import annotations

import datetime
import time
from pathlib import Path

from pyspark.sql import functions as F

from palimpsest import session
from palimpsest.llm import names, near_duplicates
from palimpsest.operators import orphans as P


def test_increment_has_a_small_plan(spark):
    """What an increment adds is planned with few exchanges, however many came before it: the driver holds these
    plans. (The old joins of each input with each: up to 61.)"""
    t = [datetime.datetime(2020, m, 1) for m in range(1, 5)]
    links = spark.createDataFrame([(i, "authors", "author_id", i % 7, t[i % 4]) for i in range(40)], "id long, target string, field string, key long, at timestamp")
    parents = spark.createDataFrame([("authors", k, t[k % 4]) for k in range(6)], "target string, key long, added timestamp")
    removed = spark.createDataFrame([("authors", 2, t[3])], "target string, key long, removed_at timestamp")
    seen = []

    def keep(df):
        seen.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning"))
        return session.cut(df)

    P.replay(spark, P.increments(links, parents, removed, t[:3]), keep=keep)
    assert len(seen) == 4 and max(seen) <= 8, seen


def files(spark) -> set[str]:
    """The shuffle files on the disks of this session."""
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {p.name for d in dirs for p in Path(d.getPath()).rglob("shuffle_*.data")}


def test_cut_deletes_what_it_shuffled(spark):
    """The rows stay when the files of the shuffle are gone."""
    before = files(spark)
    df = spark.range(1000).repartition(3).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n"))
    out = session.cut(df)
    for _ in range(50):  # the files are deleted in the background
        if not files(spark) - before:
            break
        time.sleep(0.1)
    assert not files(spark) - before
    assert sorted(r.n for r in out.collect()) == [142, 143, 143, 143, 143, 143, 143] == sorted(r.n for r in df.collect())


def runs(monkeypatch, module) -> list[int]:
    """Shuffles of each run that the module cuts: their files are on the disks together."""
    seen = []

    def cut(df):
        out = session.cut(df)
        plan = df._jdf.queryExecution().executedPlan()
        seen.append(plan.context().shuffleIds().size() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else 0)
        return out

    monkeypatch.setattr(module, "cut", cut)
    return seen


def test_meetings_of_names_are_runs_of_their_own(spark, monkeypatch):
    """Pairs from the index and each kind of pair under common keys don't lie on the disks together."""
    given = ["jean", "jeanne", "paul", "paula", "j", "p", "marie", "anne"]
    rows = [(i, "person", [f"dupont{'elstv'[i % 5]}"], [given[i % 8]]) for i in range(80)]
    d = spark.createDataFrame(rows, f"form long, {names.FORM}")
    seen = runs(monkeypatch, names)
    assert names.similar_forms(d, 3).count() > 0
    assert max(seen) <= 8, seen


def test_bands_go_in_waves(spark, monkeypatch):
    """The rows of all bands are never on the disks together, pairs of every band are found, and what the waves wrote
    is deleted."""
    titles = [f"les fouilles de {w} et de {v} au moyen age" for w in ("corinthe", "delphes", "argos", "thasos") for v in ("delos", "naxos", "paros")]
    rows = [(i, t if i < 12 else t.replace("fouilles", "fouiles"), "", 1990, "1", "2", "") for i, t in enumerate(titles * 2)]
    d = spark.createDataFrame(rows, "id long, title string, secondary_title string, year int, start_page string, volume string, doi string")
    real, made, most = near_duplicates.met, [], []

    def met(keyed, *rest):
        most.append(keyed.groupBy("id").count().agg(F.max("count")).first()[0])
        made.append(real(keyed, *rest))
        return made[-1]

    monkeypatch.setattr(near_duplicates, "met", met)
    found = {(r.a, r.b) for r in near_duplicates.matches(d)[1].collect()}
    assert {(i, i + 12) for i in range(12)} <= found
    assert sum(most) == near_duplicates.BANDS and max(most) <= near_duplicates.BANDS // 4, most
    assert all(m._files is None for m in made)
