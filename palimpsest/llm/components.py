"""Consolidating pairwise matches into groups.

``low_diameter`` (problem 6): every vertex draws an exponentially distributed shift; clusters grow from
their centres, each vertex joins the centre whose distance less its shift is smallest; clusters become
super-vertices, the edges between them the next, much smaller instance; the assignments of all levels
are composed. ``alternating_stars`` (problem 7): large-star and small-star steps until nothing changes.

Both take edges (a, b: bigint) and give (id, group_id), one row per vertex that has an edge to another
one, group_id being the group's smallest id. Loops, repeated and reversed edges are allowed, edges with
a null end are ignored, no edges give no rows. Shifts are hashes, so that a recomputed task draws the
same. A hot vertex has one row of state: joins put it against its edges, which AQE splits, and the
minimum over its neighbours is taken before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, discard


def _both_ways(edges: DataFrame) -> DataFrame:
    e = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b")
    return e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def _relax(sym: DataFrame, state: DataFrame) -> DataFrame:
    """Every vertex takes the best offer of the neighbours that changed last."""
    front = state.where("moved").select(F.col("v").alias("a"), "score", "centre")
    offers = sym.join(front, "a").groupBy(F.col("b").alias("v")).agg(F.min(F.struct((F.col("score") + 1).alias("score"), "centre")).alias("o"))
    better = F.coalesce(F.col("o.score") < F.col("score"), F.lit(False))
    return state.join(offers, "v", "left").select(
        "v", F.when(better, F.col("o.score")).otherwise(F.col("score")).alias("score"),
        F.when(better, F.col("o.centre")).otherwise(F.col("centre")).alias("centre"), better.alias("moved"),
    )


def _grow(sym: DataFrame, beta: float, level: int, steps: int = 3) -> DataFrame:
    """Clusters (v, centre) of one level. The lineage is cut once in `steps` relaxations."""
    u = (F.pmod(F.xxhash64("v", F.lit(level)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    state = sym.select(F.col("a").alias("v")).distinct().select("v", (F.log(u) / beta).alias("score"), F.col("v").alias("centre"), F.lit(True).alias("moved"))
    while True:
        older = state
        for _ in range(steps):
            state = _relax(sym, state)
        state = cut(state)
        discard(older)
        if state.where("moved").isEmpty():
            return state.select("v", "centre")


def low_diameter(edges: DataFrame, beta: float = 0.2, max_levels: int = 60) -> DataFrame:
    sym = cut(_both_ways(edges))
    levels: list[DataFrame] = []
    while not sym.isEmpty():
        if len(levels) == max_levels:
            raise RuntimeError("the decomposition did not end; raise max_levels")
        at = _grow(sym, beta, len(levels))
        levels.append(at)
        older, sym = sym, cut(
            sym.join(at.select(F.col("v").alias("a"), F.col("centre").alias("ca")), "a")
            .join(at.select(F.col("v").alias("b"), F.col("centre").alias("cb")), "b")
            .where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()
        )
        discard(older)
    if not levels:
        return edges.sparkSession.createDataFrame([], "id bigint, group_id bigint")
    # from the last level down: the super-vertices of a level are vertices of the next, if they still have edges
    top = levels.pop()
    while levels:
        below = levels.pop()
        top = below.join(top.select(F.col("v").alias("centre"), F.col("centre").alias("next")), "centre", "left").select("v", F.coalesce("next", "centre").alias("centre"))
    least = top.groupBy("centre").agg(F.min("v").alias("group_id"))
    return top.join(least, "centre").select(F.col("v").alias("id"), "group_id")


def alternating_stars(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    e = cut(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    for _ in range(max_rounds):
        sym = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = sym.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = sym.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("s")).select("s.a", "s.b").where("a <> b").distinct()
        older, e = e, cut(small)
        discard(older)
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("the stars did not settle; raise max_rounds")
    roots = e.select(F.col("b").alias("id"), F.col("b").alias("group_id")).distinct()
    return e.select(F.col("a").alias("id"), F.col("b").alias("group_id")).unionAll(roots)


def shared_value_edges(values: DataFrame) -> DataFrame:
    """Edges of rows that share a value: a star around the smallest id of each value. values: id, kind,
    value; nulls link nothing."""
    v = values.where("value IS NOT NULL AND id IS NOT NULL").distinct()
    hub = v.groupBy("kind", "value").agg(F.min("id").alias("b"), F.count("*").alias("n")).where("n > 1")
    return v.join(hub, ["kind", "value"]).where("id <> b").select(F.col("id").alias("a"), "b")
