"""References to records that do not exist, kept incrementally.

State, two logs, of which the last version of a row counts:

* index: what is known of each parent key - ``target, key, present, listed, added``;
* links: every reference that was probed - ``id, target, field, key, at, state``, and the state it had before.

``advance`` takes one increment of new references, parents that arrived and parents that were
removed. New references probe the index; an arriving parent resolves the orphans that wait under its
key (or marks them late); a removal reopens the references it leaves behind. Only references whose
key the increment touches are judged again, and only rows that change are written: an increment appends
to the logs, nothing is rewritten. ``history`` adds up the changes to the counts after every increment.

Defined results: references with a null key are no cases. A null date on either side never makes a
reference late. Parents given twice count once, with their earliest date; a parent that arrives and
is removed in one increment is present (the row was put back). Empty tables give empty tables. The
same link under two ids is two links; one id given twice is one link. Other columns of the inputs are ignored.

Scale: parents are one row per key; a hot key holds many links but a single index row, so that joins
of links with the index can be split by AQE on the link side, and nothing groups the links of a key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut

INDEX = "target string, key bigint, present boolean, listed boolean, added timestamp, seq int"
LINKS = "id bigint, target string, field string, key bigint, at timestamp, state string, was string, seq int"


def _last(log: DataFrame, *keys: str) -> DataFrame:
    """The last version of every row of a log."""
    rest = [c for c in log.columns if c not in keys]
    best = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), "seq").alias("_v"))
    return best.select(*keys, *[F.col("_v")[c].alias(c) for c in rest])


@dataclass
class OrphanState:
    index_log: DataFrame
    link_log: DataFrame
    seq: int = 0
    counted: DataFrame | None = None  # changes of counts by increments that compact() left out of the log

    @property
    def index(self) -> DataFrame:
        return _last(self.index_log, "target", "key").drop("seq")

    @property
    def links(self) -> DataFrame:
        return _last(self.link_log, "id", "field").select("id", "target", "field", "key", "at", "state")


def empty_state(spark: SparkSession) -> OrphanState:
    return OrphanState(spark.createDataFrame([], INDEX), spark.createDataFrame([], LINKS))


def references(df: DataFrame, fields: dict[str, str], id_col: str = "id", at: str = "date_added") -> DataFrame:
    """References of a link table in long form; fields: target table by key column."""
    pairs = F.explode(F.array(*[F.struct(F.lit(t).alias("target"), F.lit(f).alias("field"), F.col(f).cast("bigint").alias("key")) for f, t in fields.items()])).alias("r")
    return df.select(F.col(id_col).cast("bigint").alias("id"), F.col(at).cast("timestamp").alias("at"), pairs).select("id", "r.target", "r.field", "r.key", "at").where("key IS NOT NULL")


def _state() -> Column:
    present = F.coalesce(F.col("present"), F.lit(False))
    late = F.coalesce(F.col("added") > F.col("at"), F.lit(False))
    return F.when(present & late, "late").when(present, "ok").when(F.coalesce(F.col("listed"), F.lit(False)), "deleted").otherwise("missing")


def advance(state: OrphanState, links: DataFrame, parents: DataFrame, removed: DataFrame, keep=cut) -> OrphanState:
    """The state after one increment. links: as references() gives them; parents: target, key, added;
    removed: target, key. keep cuts the lineage of what the increment adds."""
    seq = state.seq + 1
    null = lambda t: F.lit(None).cast(t)
    no, yes, never = F.lit(False), F.lit(True), null("timestamp")

    def said(df: DataFrame, came: Column, gone: Column, at: Column) -> DataFrame:
        return df.select("target", "key", came.alias("came"), gone.alias("gone"), at.alias("came_at"), null("boolean").alias("present"), null("boolean").alias("listed"), never.alias("added"), null("int").alias("seq"))

    # what the increment says of a key and what the index knows of it meet in one aggregation; joins of each with
    # each would make plans that fill the driver
    known = said(parents, yes, no, F.col("added")).unionByName(said(removed, no, yes, never)).unionByName(said(links, no, no, never))
    known = known.unionByName(state.index_log.select("target", "key", no.alias("came"), no.alias("gone"), never.alias("came_at"), "present", "listed", "added", "seq")).where("key IS NOT NULL")
    known = known.groupBy("target", "key").agg(
        F.max("came").alias("came"), F.max("gone").alias("gone"), F.min("came_at").alias("came_at"), F.max(F.col("seq").isNull()).alias("asked"),
        F.coalesce(F.max_by("present", "seq"), no).alias("present"), F.coalesce(F.max_by("listed", "seq"), no).alias("listed"), F.max_by("added", "seq").alias("added"),
    ).where("asked").select(
        "target", "key", (F.col("came") | F.col("gone")).alias("touched"), (F.col("came") | (F.col("present") & ~F.col("gone"))).alias("present"), (F.col("listed") | F.col("gone")).alias("listed"),
        F.when(F.col("came") & F.col("present"), F.least("added", "came_at")).when(F.col("came"), F.col("came_at")).otherwise(F.col("added")).alias("added"),
    )
    # new links, and of the links under touched keys the last version
    probes = links.select("id", "target", "field", "key", "at", null("string").alias("was"), null("int").alias("seq")).unionByName(state.link_log.select("id", "target", "field", "key", "at", F.col("state").alias("was"), "seq"))
    met = probes.join(known, ["target", "key"], "left").where("seq IS NULL OR touched")
    last = met.groupBy("id", "field", F.col("seq").isNull().alias("fresh")).agg(F.max_by(F.struct("target", "key", "at", "was", "present", "listed", "added"), F.coalesce("seq", F.lit(0))).alias("v"))
    judged = last.select("id", "field", "v.*").select("id", "target", "field", "key", "at", _state().alias("state"), "was").where("was IS NULL OR was <> state")
    # both logs grow by one result, so that an increment is one job
    rows = known.where("touched").select("target", "key", "present", "listed", "added", null("bigint").alias("id"), null("string").alias("field"), null("timestamp").alias("at"), null("string").alias("state"), null("string").alias("was"))
    rows = keep(rows.unionByName(judged.select("target", "key", null("boolean").alias("present"), null("boolean").alias("listed"), null("timestamp").alias("added"), "id", "field", "at", "state", "was")).withColumn("seq", F.lit(seq)))
    return OrphanState(
        state.index_log.unionByName(rows.where("field IS NULL").select("target", "key", "present", "listed", "added", "seq")),
        state.link_log.unionByName(rows.where("field IS NOT NULL").select("id", "target", "field", "key", "at", "state", "was", "seq")), seq, state.counted,
    )


def _changes(links: DataFrame) -> DataFrame:
    month = F.date_format("at", "yyyy-MM").alias("month")
    change = F.explode(F.array(F.struct(F.col("was").alias("state"), F.lit(-1).alias("d")), F.struct(F.col("state").alias("state"), F.lit(1).alias("d")))).alias("c")
    return links.where("was IS NULL OR was <> state").select("seq", "field", month, change).where("c.state IS NOT NULL AND c.state <> 'ok'").groupBy("seq", "field", "month", "c.state").agg(F.sum("c.d").alias("d"))


def compact(state: OrphanState, keep=cut) -> OrphanState:
    """The same state with the last versions only, so that logs of many increments are read as one."""
    counted = _changes(state.link_log)
    if state.counted is not None:
        counted = counted.unionByName(state.counted)
    counted = keep(counted)
    links = state.links.withColumn("was", F.col("state")).withColumn("seq", F.lit(state.seq))
    return OrphanState(keep(state.index.withColumn("seq", F.lit(state.seq))), keep(links), state.seq, counted)


def orphans(state: OrphanState) -> DataFrame:
    return state.links.where("state <> 'ok'").select("id", "field", "state")


def snapshot(state: OrphanState) -> DataFrame:
    """Orphans per field, month of the reference's date (null for undated) and state."""
    month = F.date_format("at", "yyyy-MM").alias("month")
    return state.links.groupBy("field", month, "state").agg(F.count("*").alias("n")).where("state <> 'ok'")


def history(state: OrphanState) -> DataFrame:
    """(seq, field, month, state, n): the counts of ``snapshot`` after every increment, from the changes of all."""
    changes = _changes(state.link_log)
    if state.counted is not None:
        changes = changes.unionByName(state.counted)
    # a change counts in its increment and all later ones; there are months x states x increments of them
    later = changes.select(F.explode(F.sequence(F.col("seq"), F.lit(state.seq))).alias("seq"), "field", "month", "state", "d")
    return later.groupBy("seq", "field", "month", "state").agg(F.sum("d").alias("n")).where("n > 0")


def increments(links: DataFrame, parents: DataFrame, removed: DataFrame, cuts: list) -> list[tuple]:
    """The inputs split at the given times, each increment up to and with its time; undated rows come
    first. removed needs a column removed_at."""
    def part(df: DataFrame, c: str, lo, hi) -> DataFrame:
        t = F.col(c)
        cond = F.lit(True) if hi is None else (t <= F.lit(hi))
        cond = (t.isNull() | cond) if lo is None else (cond & (t > F.lit(lo)))
        return df.where(cond)

    edges = [None, *cuts, None]
    return [(part(links, "at", a, b), part(parents, "added", a, b), part(removed, "removed_at", a, b).select("target", "key")) for a, b in zip(edges, edges[1:])]


def replay(spark: SparkSession, steps: list[tuple], keep=cut, every: int = 6) -> OrphanState:
    """All increments one after the other; keep cuts the lineage between them, and once in `every` increments
    the logs are compacted."""
    state = empty_state(spark)
    for step in steps:
        state = advance(state, *step, keep=keep)
        if state.seq % every == 0:
            state = compact(state, keep)
    return state
