"""The queries of problems 1 and 3 to 10, and SQL where it can give their rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identifiers as I
from ..session import table
from . import names
from .bpe import encode_texts
from .components import low_diameter, shared_value_edges
from .linkage import link
from .near_duplicates import groups, pairs_of
from .ocr import continuous, repairs
from .packing import pack
from .survivors import survive
from .truncation import judge, shares


def identifier_groups(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "authors")
    values = a.select(F.col("id").cast("bigint").alias("id"), F.explode(F.array(
        F.struct(F.lit("ppn").alias("kind"), I.ppn(F.col("PPN_IDREF")).alias("value")), F.struct(F.lit("viaf").alias("kind"), I.viaf(F.col("PPN_VIAF")).alias("value"))
    )).alias("v")).select("id", "v.kind", "v.value")
    return low_diameter(shared_value_edges(values))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return identifier_groups(spark, d)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "authors").select("id", "orcid", "PPN_IDREF", "date_modified").join(identifier_groups(spark, d), "id")
    return survive(rows, {"orcid": I.orcid(F.col("orcid")), "PPN_IDREF": I.ppn(F.col("PPN_IDREF"))})


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs_of(groups(table(spark, d, "reference")))


def p7_groups(spark: SparkSession, d: str) -> DataFrame:
    return groups(table(spark, d, "reference"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_texts(table(spark, d, "documents"))


def p9_packing(spark: SparkSession, d: str) -> DataFrame:
    return pack(table(spark, d, "documents"), table(spark, d, "conteneurs"))


def p3_links(spark: SparkSession, d: str) -> DataFrame:
    return link(*[table(spark, d, t) for t in ("reference", "ecriture", "authors", "jstor_meta")])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_links(spark, d).select("reference_id", "item_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return names.pairs(names.people(table(spark, d, "authors")))


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    return names.groups(table(spark, d, "authors"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return repairs(table(spark, d, "corpus_propre")).select("doc_id", "idx")


def p5_text(spark: SparkSession, d: str) -> DataFrame:
    corpus = table(spark, d, "corpus_propre")
    return continuous(corpus, repairs(corpus))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return judge(table(spark, d, "documents")).where("odds > 0").select("doc_id").distinct()


def p10_shares(spark: SparkSession, d: str) -> DataFrame:
    return shares(judge(table(spark, d, "documents")))


_GROUPS = r"""
WITH RECURSIVE clean AS (
  SELECT id, date_modified,
    regexp_replace(regexp_replace(upper(regexp_replace(trim(PPN_IDREF), '(?i)^(\(?idref\)?|ppn)[\s:/]*', '')), '\.0$', ''), '[\s\x{00a0}-]', '', 'g') AS p0, CASE WHEN length(p0) BETWEEN 7 AND 8 THEN lpad(p0, 9, '0') ELSE p0 END AS p,
    regexp_replace(regexp_replace(regexp_replace(trim(PPN_VIAF, ' ' || chr(160)), '(?i)^viaf[\s:/]*', ''), '/+$', ''), '\.0$', '') AS v,
    regexp_replace(regexp_replace(upper(trim(orcid, ' ' || chr(160))), '^ORCID[\s:/]*', ''), '[\s\x{2010}-\x{2015}-]', '', 'g') AS o
  FROM authors),
valid AS (
  SELECT id, date_modified,
    CASE WHEN regexp_matches(p, '^[0-9]{8}[0-9X]$') AND p <> '000000000' AND substr(p, 9, 1) =
      CASE (11 - list_sum(list_transform(range(1, 9), lambda i: coalesce(try_cast(substr(p, i::int, 1) AS int), 0) * (10 - i))) % 11) % 11 WHEN 10 THEN 'X'
      ELSE ((11 - list_sum(list_transform(range(1, 9), lambda i: coalesce(try_cast(substr(p, i::int, 1) AS int), 0) * (10 - i))) % 11) % 11)::int::varchar END THEN p END AS p,
    CASE WHEN regexp_matches(v, '^[1-9][0-9]{4,21}$') THEN v END AS v,
    CASE WHEN regexp_matches(o, '^[0-9]{15}[0-9X]$') AND substr(o, 16, 1) =
      CASE (12 - list_reduce(list_transform(range(1, 16), lambda i: coalesce(try_cast(substr(o, i::int, 1) AS int), 0)), lambda a, b: ((a + b) * 2) % 11, 0) % 11) % 11 WHEN 10 THEN 'X'
      ELSE ((12 - list_reduce(list_transform(range(1, 16), lambda i: coalesce(try_cast(substr(o, i::int, 1) AS int), 0)), lambda a, b: ((a + b) * 2) % 11, 0) % 11) % 11)::int::varchar END
      THEN substr(o, 1, 4) || '-' || substr(o, 5, 4) || '-' || substr(o, 9, 4) || '-' || substr(o, 13, 4) END AS o
  FROM clean),
links AS (SELECT a.id AS a, b.id AS b FROM valid a JOIN valid b ON (a.p = b.p OR a.v = b.v) AND a.id <> b.id),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
grp AS (SELECT a AS id, min(least(a, b)) AS group_id FROM reach GROUP BY a)
"""

QUERIES = {"p1_found": p1_found, "p3_found": p3_found, "p3_links": p3_links, "p4_found": p4_found, "p4_groups": p4_groups, "p5_found": p5_found, "p5_text": p5_text, "p6_found": p6_found, "p7_found": p7_found, "p7_groups": p7_groups, "p8_ids": p8_ids, "p9_packing": p9_packing, "p10_found": p10_found, "p10_shares": p10_shares}
SQL = {
    "p6_found": _GROUPS + "SELECT id, group_id FROM grp",
    "p1_found": _GROUPS + """SELECT g.group_id AS id,
      coalesce(first(v.o ORDER BY v.date_modified DESC NULLS LAST, v.id) FILTER (WHERE v.o IS NOT NULL), '') AS orcid,
      coalesce(first(v.p ORDER BY v.date_modified DESC NULLS LAST, v.id) FILTER (WHERE v.p IS NOT NULL), '') AS PPN_IDREF
      FROM grp g JOIN valid v USING (id) GROUP BY 1""",
}
