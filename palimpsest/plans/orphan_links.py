"""Problem 2: links of ecriture to rows of authors and reference that don't exist."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.orphans import OrphanState, advance, history, increments, orphans, references, replay
from ..session import cut, table

FIELDS = {"author_id": "authors", "reference_id": "reference"}


def link_state(spark: SparkSession, d: str, months: int) -> tuple[OrphanState, list[str]]:
    """The state after all of ecriture, its parents and the log of suppressions, in increments of so many
    months, and the names of the increments. Each knows what came up to its end and no more: a removal reopens
    the links to its row, an arrival resolves those that wait. A last increment compares the index with the
    tables as they are now: rows that are there though their removal was logged were put back, at a time that
    no table tells."""
    links = references(table(spark, d, "ecriture"), FIELDS)
    parents = None
    for t in FIELDS.values():
        p = table(spark, d, t).select(F.lit(t).alias("target"), F.col("id").cast("bigint").alias("key"), F.col("date_added").cast("timestamp").alias("added"))
        parents = p if parents is None else parents.unionByName(p)
    removed = table(spark, d, "suppressions").select(
        F.lower(F.trim("table_cible")).alias("target"), F.col("record_id").cast("bigint").alias("key"), F.col("date_suppression").cast("timestamp").alias("removed_at")
    ).where(F.col("target").isin(*FIELDS.values()) & F.col("key").isNotNull())
    lo, hi = links.agg(F.min("at"), F.max("at")).first()
    cuts = []
    if lo is not None:
        y, m = divmod(lo.year * 12 + lo.month - 1 + months, 12)
        while (c := datetime.datetime(y, m + 1, 1)) < hi:
            cuts.append(c)
            y, m = divmod(y * 12 + m + months, 12)
    state = replay(spark, increments(links, parents, removed, cuts), keep=cut)
    absent = state.index.where("NOT present").select("target", "key")
    state = advance(state, links.limit(0), parents.join(absent, ["target", "key"], "left_semi"), removed.select("target", "key").limit(0), keep=cut)
    return state, [*[f"before {c:%Y-%m}" for c in cuts], "all", "now"]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans(link_state(spark, d, 12)[0])


def p2_counts(spark: SparkSession, d: str) -> DataFrame:
    """(snapshot, field, month, state, n): what was an orphan after each month, and is one now."""
    state, names = link_state(spark, d, 1)
    label = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("seq"))
    return history(state).select(label.alias("snapshot"), "field", "month", "state", "n")


_CTE = """
WITH gone AS (SELECT DISTINCT lower(trim(table_cible)) AS t, record_id AS k FROM suppressions),
judged AS (
  SELECT e.id, 'author_id' AS field, e.date_added AS since,
    CASE WHEN a.id IS NOT NULL AND a.date_added > e.date_added THEN 'late' WHEN a.id IS NOT NULL THEN 'ok'
         WHEN g.k IS NOT NULL THEN 'deleted' ELSE 'missing' END AS state
  FROM ecriture e LEFT JOIN authors a ON a.id = e.author_id LEFT JOIN gone g ON g.t = 'authors' AND g.k = e.author_id
  WHERE e.author_id IS NOT NULL
  UNION ALL
  SELECT e.id, 'reference_id', e.date_added,
    CASE WHEN r.id IS NOT NULL AND r.date_added > e.date_added THEN 'late' WHEN r.id IS NOT NULL THEN 'ok'
         WHEN g.k IS NOT NULL THEN 'deleted' ELSE 'missing' END
  FROM ecriture e LEFT JOIN reference r ON r.id = e.reference_id LEFT JOIN gone g ON g.t = 'reference' AND g.k = e.reference_id
  WHERE e.reference_id IS NOT NULL)
"""

QUERIES = {"p2_found": p2_found, "p2_counts": p2_counts}
SQL = {
    "p2_found": _CTE + "SELECT id, field, state FROM judged WHERE state <> 'ok'",
    "p2_counts": """
WITH ends AS (SELECT strftime(m, '%Y-%m') AS name, m AS till FROM (SELECT unnest(range(date_trunc('month', min(date_added)) + INTERVAL 1 MONTH, max(date_added), INTERVAL 1 MONTH)) AS m
    FROM (SELECT date_added FROM ecriture WHERE author_id IS NOT NULL OR reference_id IS NOT NULL))
  UNION ALL SELECT 'all', TIMESTAMP '9999-01-01' UNION ALL SELECT 'now', TIMESTAMP '9999-01-02'),
steps AS (SELECT name, till, row_number() OVER (ORDER BY till) AS seq FROM ends),
links AS (SELECT id, 'author_id' AS field, 'authors' AS t, author_id AS k, date_added AS since FROM ecriture WHERE author_id IS NOT NULL
  UNION ALL SELECT id, 'reference_id', 'reference', reference_id, date_added FROM ecriture WHERE reference_id IS NOT NULL),
rows_ AS (SELECT 'authors' AS t, id AS k, date_added AS added FROM authors UNION ALL SELECT 'reference', id, date_added FROM reference),
came AS (SELECT t, k, added, coalesce((SELECT min(seq) FROM steps WHERE added <= till), 1) AS seq FROM rows_),
gone AS (SELECT lower(trim(table_cible)) AS t, record_id AS k, coalesce((SELECT min(seq) FROM steps WHERE date_suppression <= till), 1) AS seq FROM suppressions WHERE record_id IS NOT NULL),
probed AS (SELECT l.*, coalesce((SELECT min(seq) FROM steps WHERE since <= till), 1) AS seq FROM links l),
at_ AS (
  SELECT s.seq, s.name, p.id, p.field, p.since, c.k IS NOT NULL AND c.seq <= s.seq AS there, c.added, s.name = 'now' AS now,
    (SELECT max(g.seq) FROM gone g WHERE g.t = p.t AND g.k = p.k AND g.seq <= s.seq) AS removed, c.seq AS came
  FROM steps s JOIN probed p ON p.seq <= s.seq LEFT JOIN came c ON c.t = p.t AND c.k = p.k),
judged AS (SELECT name, field, since, CASE
    WHEN there AND (now OR removed IS NULL OR removed <= came) THEN CASE WHEN added > since THEN 'late' ELSE 'ok' END
    WHEN removed IS NOT NULL THEN 'deleted' ELSE 'missing' END AS state FROM at_)
SELECT CASE WHEN name IN ('all', 'now') THEN name ELSE 'before ' || name END AS snapshot, field, strftime(since, '%Y-%m') AS month, state, count(*) AS n FROM judged WHERE state <> 'ok' GROUP BY 1, 2, 3, 4""",
}
