"""Bibliometric time series: counts, shares, grids, windows, joins and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.identifiers import present
from ..operators import tabular as O
from ..session import table
from .registry import Registry

query = Registry()
QUERIES, SQL = query.queries, query.sql


def year_of(c: str):
    return F.year(c)


def orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").withColumn("y", year_of("o_orderdate"))


def order_nations(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    return orders(spark, d).join(c, F.col("o_custkey") == F.col("c_custkey"))


_ON = "orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"


@query("SELECT year, count(*) AS n FROM reference WHERE year BETWEEN 1975 AND 2025 GROUP BY 1")
def refs_per_year(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "reference").where(F.col("year").between(1975, 2025)).groupBy("year").agg(F.count("*").alias("n")).orderBy("year")


@query(f"""WITH t AS (SELECT n_name FROM {_ON} GROUP BY 1 ORDER BY count(*) DESC, n_name LIMIT 6)
SELECT CASE WHEN n_name IN (SELECT n_name FROM t) THEN n_name ELSE 'Other' END AS label, count(*) AS n FROM {_ON} GROUP BY 1""")
def top_n_other_bucket(spark: SparkSession, d: str) -> DataFrame:
    return O.other_bucket(order_nations(spark, d), "n_name", 6).groupBy(F.col("n_name").alias("label")).agg(F.count("*").alias("n"))


@query(f"""WITH c AS (SELECT year(o_orderdate)::int AS y, n_name, count(*) AS n FROM {_ON} GROUP BY 1, 2),
g AS (SELECT y, n_name FROM (SELECT unnest(range(min(y), max(y) + 1))::int AS y FROM c) CROSS JOIN (SELECT n_name FROM nation))
SELECT y, n_name, coalesce(n, 0) AS n FROM g LEFT JOIN c USING (y, n_name)""")
def complete_grid_zero_fill(spark: SparkSession, d: str) -> DataFrame:
    c = order_nations(spark, d).groupBy("y", "n_name").agg(F.count("*").alias("n"))
    return O.complete(c, {"y": O.calendar(c, "y"), "n_name": table(spark, d, "nation")})


@query(f"""WITH t AS (SELECT n_name FROM {_ON} GROUP BY 1 ORDER BY count(*) DESC, n_name LIMIT 6),
b AS (SELECT year(o_orderdate)::int AS y, CASE WHEN n_name IN (SELECT n_name FROM t) THEN n_name ELSE 'Other' END AS label FROM {_ON}),
c AS (SELECT y, label, count(*) AS n FROM b GROUP BY 1, 2),
g AS (SELECT y, label FROM (SELECT unnest(range(min(y), max(y) + 1))::int AS y FROM b) CROSS JOIN (SELECT DISTINCT label FROM b)),
f AS (SELECT y, label, coalesce(n, 0) AS n FROM g LEFT JOIN c USING (y, label))
SELECT y, label, n, round(n::double / sum(n) OVER (PARTITION BY y), 6) AS share FROM f""")
def yearly_share_topn(spark: SparkSession, d: str) -> DataFrame:
    b = O.other_bucket(order_nations(spark, d), "n_name", 6).withColumnRenamed("n_name", "label")
    c = b.groupBy("y", "label").agg(F.count("*").alias("n"))
    return O.complete(c, {"y": O.calendar(c, "y"), "label": c}).withColumn("share", F.round(O.share_of("n", "y"), 6))


@query("""WITH l AS (SELECT year, CASE lower(split_part(split_part(trim(language), '-', 1), '_', 1)) WHEN 'english' THEN 'en' WHEN 'french' THEN 'fr' WHEN 'german' THEN 'de' WHEN 'spanish' THEN 'es' WHEN 'italian' THEN 'it'
 WHEN 'arabic' THEN 'ar' WHEN 'chinese' THEN 'zh' WHEN 'russian' THEN 'ru' WHEN 'turkish' THEN 'tr' ELSE lower(split_part(split_part(trim(language), '-', 1), '_', 1)) END AS k FROM reference WHERE year BETWEEN 1975 AND 2025),
v AS (SELECT year, CASE WHEN k IN ('en','fr','de','it','es','pt','nl','pl','ru','ar','zh','ja','tr','el','cs','ro','hu','sv','no','da','fi','uk','ca','hr','sk','bg','lt','sl','et','lv','ko','vi','th','id') THEN k END AS language FROM l),
c AS (SELECT year, language, count(*) AS n FROM v WHERE language IS NOT NULL GROUP BY 1, 2)
SELECT year, language, n, round(n::double / sum(n) OVER (PARTITION BY year), 6) AS share FROM c""")
def language_share_by_year(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "reference").where(F.col("year").between(1975, 2025)).select("year", T.language_code(F.col("language")).alias("language")).where("language IS NOT NULL")
    return r.groupBy("year", "language").agg(F.count("*").alias("n")).withColumn("share", F.round(O.share_of("n", "year"), 6))


def _ma(width: int) -> str:
    k = width // 2
    return f"""WITH c AS (SELECT year, count(*) AS n FROM reference WHERE year IS NOT NULL GROUP BY 1),
f AS (SELECT g.year, coalesce(n, 0) AS n FROM (SELECT unnest(range(min(year), max(year) + 1))::int AS year FROM c) g LEFT JOIN c USING (year))
SELECT year, n, CASE WHEN count(*) OVER w = {width} THEN round(avg(n) OVER w, 6) END AS ma FROM f WINDOW w AS (ORDER BY year ROWS BETWEEN {k} PRECEDING AND {k} FOLLOWING)"""


def _moving(spark: SparkSession, d: str, width: int) -> DataFrame:
    c = table(spark, d, "reference").where("year IS NOT NULL").groupBy("year").agg(F.count("*").alias("n"))
    return O.complete(c, {"year": O.calendar(c, "year")}).withColumn("ma", F.round(O.centred_average("n", width, "year"), 6))


@query(_ma(5))
def moving_avg_centered_5(spark: SparkSession, d: str) -> DataFrame:
    return _moving(spark, d, 5)


@query(_ma(3))
def moving_avg_centered_3(spark: SparkSession, d: str) -> DataFrame:
    return _moving(spark, d, 3)


@query(f"""WITH c AS (SELECT n_name, year(o_orderdate)::int AS y, count(*) AS n FROM {_ON} GROUP BY 1, 2)
SELECT n_name, y, n, (sum(n) OVER (PARTITION BY n_name ORDER BY y ROWS UNBOUNDED PRECEDING))::bigint AS running FROM c""")
def cumulative_by_group(spark: SparkSession, d: str) -> DataFrame:
    return order_nations(spark, d).groupBy("n_name", "y").agg(F.count("*").alias("n")).withColumn("running", O.running_sum("n", "y", "n_name"))


@query("""WITH f AS (SELECT author_id, min(year) AS first FROM ecriture JOIN reference ON reference.id = reference_id WHERE author_id IS NOT NULL AND year IS NOT NULL GROUP BY 1)
SELECT (first // 10 * 10)::int || 's' AS decade, first, count(*) AS authors FROM f GROUP BY 1, 2""")
def first_year_entry(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "reference").select(F.col("id").alias("reference_id"), "year")
    f = table(spark, d, "ecriture").where("author_id IS NOT NULL").join(r, "reference_id").where("year IS NOT NULL").groupBy("author_id").agg(F.min("year").alias("first"))
    return f.groupBy(O.decade(F.col("first")).alias("decade"), "first").agg(F.count("*").alias("authors"))


@query("""WITH l AS (SELECT DISTINCT l_orderkey, n_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)
SELECT n_name, round(sum(1.0::double / k), 4) AS weight FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS k FROM l) GROUP BY 1""")
def fractional_weight_1_over_n(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), "n_name")
    return O.fractional(table(spark, d, "lineitem").join(s, "l_suppkey"), "l_orderkey", "n_name").withColumn("weight", F.round("weight", 4))


@query(f"""SELECT n_name, n, rank FROM (SELECT n_name, count(*) AS n, (row_number() OVER (ORDER BY count(*) DESC, n_name))::int AS rank FROM {_ON} GROUP BY 1) WHERE rank BETWEEN 2 AND 7""")
def rank_slice_2_7(spark: SparkSession, d: str) -> DataFrame:
    return O.rank_slice(order_nations(spark, d).groupBy("n_name").agg(F.count("*").alias("n")), "n_name", 2, 7)


@query("""SELECT coalesce(language, '(none)') AS language, count(*) FILTER (WHERE year // 10 = 197) AS s1970, count(*) FILTER (WHERE year // 10 = 198) AS s1980, count(*) FILTER (WHERE year // 10 = 199) AS s1990,
count(*) FILTER (WHERE year // 10 = 200) AS s2000, count(*) FILTER (WHERE year // 10 = 201) AS s2010, count(*) FILTER (WHERE year // 10 = 202) AS s2020 FROM reference WHERE year BETWEEN 1970 AND 2029 GROUP BY 1""")
def decade_pivot(spark: SparkSession, d: str) -> DataFrame:
    decades = [f"{y}s" for y in range(1970, 2030, 10)]
    r = table(spark, d, "reference").where(F.col("year").between(1970, 2029)).select(F.coalesce("language", F.lit("(none)")).alias("language"), O.decade(F.col("year")).alias("dec"))
    p = r.groupBy("language").pivot("dec", decades).agg(F.count(F.lit(1))).na.fill(0)
    return p.toDF("language", *[f"s{x[:-1]}" for x in decades])


@query("""SELECT o_orderpriority, count(*) AS n, round(100.0::double * count(*) FILTER (WHERE regexp_matches(o_orderstatus, '(?i)^f')) / count(*), 6) AS share, round(avg(o_totalprice), 4) AS mean, min(o_totalprice) AS least, max(o_totalprice) AS largest FROM orders GROUP BY 1""")
def conditional_share(spark: SparkSession, d: str) -> DataFrame:
    hit = F.sum(F.when(F.col("o_orderstatus").rlike("(?i)^f"), 1).otherwise(0))
    return orders(spark, d).groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(100.0 * hit / F.count("*"), 6).alias("share"), F.round(F.avg("o_totalprice"), 4).alias("mean"), F.min("o_totalprice").alias("least"), F.max("o_totalprice").alias("largest"))


@query(r"""SELECT CASE WHEN regexp_matches(n_name, '(?i)united states|^usa$') THEN 'US' WHEN regexp_matches(n_name, '(?i)united kingdom|britain') THEN 'UK' WHEN regexp_matches(n_name, '(?i)^france$') THEN 'FR' WHEN n_name IS NULL THEN 'Unknown' ELSE 'Other' END AS grp,
count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def multi_group_case_when(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    n = F.col("n_name")
    grp = F.when(n.rlike("(?i)united states|^usa$"), "US").when(n.rlike("(?i)united kingdom|britain"), "UK").when(n.rlike("(?i)^france$"), "FR").when(n.isNull(), "Unknown").otherwise("Other")
    return c.groupBy(grp.alias("grp")).agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("""WITH a AS (SELECT l_orderkey, list_sort(list_distinct(list(n_name))) AS ns FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1)
SELECT l_orderkey, array_to_string(list_filter(ns, lambda x: x <> 'FRANCE'), '|') AS others, len(ns) > 1 AS multi FROM a WHERE list_contains(ns, 'FRANCE')""")
def array_setdiff_multinational(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), "n_name")
    a = table(spark, d, "lineitem").join(s, "l_suppkey").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("n_name")).alias("ns"))
    return a.where(F.array_contains("ns", "FRANCE")).select("l_orderkey", F.array_join(F.array_except("ns", F.array(F.lit("FRANCE"))), "|").alias("others"), (F.size("ns") > 1).alias("multi"))


@query("""SELECT c_mktsegment, count(o_totalprice) AS n, round(avg(o_totalprice), 4) AS mean, min(o_totalprice) AS least, round(quantile_cont(o_totalprice, 0.25), 4) AS q1, round(quantile_cont(o_totalprice, 0.5), 4) AS median,
round(quantile_cont(o_totalprice, 0.75), 4) AS q3, max(o_totalprice) AS largest FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def median_quartile_boxplot(spark: SparkSession, d: str) -> DataFrame:
    o = orders(spark, d).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    b = o.groupBy("c_mktsegment").agg(*O.box_plot("o_totalprice"))
    return b.withColumns({c: F.round(c, 4) for c in ("mean", "q1", "median", "q3")})


@query("""SELECT a.id, count(r.id)::int AS publications, coalesce(sum(r.year), 0)::bigint AS years FROM authors a LEFT JOIN (SELECT DISTINCT author_id, reference_id FROM ecriture) e ON e.author_id = a.id LEFT JOIN reference r ON r.id = e.reference_id GROUP BY 1""")
def left_join_nest(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "ecriture").select("author_id", "reference_id").distinct()
    r = table(spark, d, "reference").select(F.col("id").alias("rid"), "title", "year")
    a = table(spark, d, "authors").select("id").join(e, F.col("id") == F.col("author_id"), "left").join(r, F.col("reference_id") == F.col("rid"), "left")
    pubs = F.array_sort(F.collect_list(F.when(F.col("rid").isNotNull(), F.struct("rid", "title", "year"))))
    n = a.groupBy("id").agg(pubs.alias("publications"))
    return n.select("id", F.size("publications").alias("publications"), F.aggregate("publications", F.lit(0).cast("bigint"), lambda s, p: s + F.coalesce(p["year"], F.lit(0))).alias("years"))


@query(r"""WITH l AS (SELECT DISTINCT id, k FROM (SELECT id, lower(regexp_replace(unnest(regexp_split_to_array(issn, '[;,]')), '[\s-]', '', 'g')) AS k FROM reference WHERE issn IS NOT NULL) WHERE k <> ''),
r AS (SELECT DISTINCT item_id, k FROM (SELECT item_id, lower(regexp_replace(unnest([identifiers.print_issn, identifiers.online_issn, identifiers.journal_code]), '[\s-]', '', 'g')) AS k FROM jstor_meta) WHERE k <> '')
SELECT DISTINCT id, item_id FROM l JOIN r USING (k)""")
def multi_key_explode_join(spark: SparkSession, d: str) -> DataFrame:
    left = O.explode_keys(table(spark, d, "reference"), "id", "issn")
    j = table(spark, d, "jstor_meta").select("item_id", F.col("identifiers.print_issn").alias("p"), F.col("identifiers.online_issn").alias("o"), F.col("identifiers.journal_code").alias("c"))
    return left.join(O.explode_keys(j, "item_id", "p", "o", "c"), "k").select("id", "item_id").distinct()


@query("""WITH a AS (SELECT year(o_orderdate)::int AS y, count(*) AS orders FROM orders GROUP BY 1), b AS (SELECT year(l_shipdate)::int AS y, count(*) AS lines FROM lineitem GROUP BY 1), c AS (SELECT year AS y, count(*) AS refs FROM reference WHERE year IS NOT NULL GROUP BY 1)
SELECT y, coalesce(orders, 0) AS orders, coalesce(lines, 0) AS lines, coalesce(refs, 0) AS refs FROM a FULL JOIN b USING (y) FULL JOIN c USING (y)""")
def full_outer_fill_zero(spark: SparkSession, d: str) -> DataFrame:
    a = orders(spark, d).groupBy("y").agg(F.count("*").alias("orders"))
    b = table(spark, d, "lineitem").groupBy(F.year("l_shipdate").alias("y")).agg(F.count("*").alias("lines"))
    c = table(spark, d, "reference").where("year IS NOT NULL").groupBy(F.col("year").alias("y")).agg(F.count("*").alias("refs"))
    return O.full_outer([a, b, c], "y")


@query("""SELECT c_custkey, coalesce(nullif(trim(CASE WHEN c_custkey % 3 = 0 THEN s_name END), ''), c_name) AS name FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey""")
def coalesce_correction_join(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("fix"))
    j = table(spark, d, "customer").join(s, "c_custkey", "left")
    return j.select("c_custkey", O.fill_if_empty(F.when(F.col("c_custkey") % 3 == 0, F.col("fix")), F.col("c_name")).alias("name"))


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)")
def semi_join_keys(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.readers import by_keys

    return by_keys(table(spark, d, "customer"), orders(spark, d).where("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000 AND o_custkey IS NOT NULL)")
def anti_join_done(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.readers import unprocessed

    return unprocessed(table(spark, d, "customer"), orders(spark, d).where("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey").select("c_custkey")


@query("SELECT a.id AS a, b.id AS b FROM reference a JOIN reference b ON a.id < b.id AND abs(a.year - b.year) <= 1 AND a.secondary_title = b.secondary_title")
def band_join_plus_minus_one(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "reference").where("year IS NOT NULL AND secondary_title IS NOT NULL")
    return O.band_pairs(r, "id", "year", 1, "secondary_title")


@query("""WITH s AS (SELECT user_id, 1 AS priority, min(event_id) AS event_id FROM events WHERE event_type = 'purchase' AND value > 120 GROUP BY 1 UNION ALL
SELECT user_id, 2, min(event_id) FROM events WHERE event_type = 'signup' AND value > 150 GROUP BY 1 UNION ALL SELECT user_id, 3, min(event_id) FROM events WHERE event_type = 'view' GROUP BY 1)
SELECT user_id, priority, event_id FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY priority) = 1""")
def priority_source_pick(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    src = [("event_type = 'purchase' AND value > 120"), ("event_type = 'signup' AND value > 150"), ("event_type = 'view'")]
    return O.priority_pick([e.where(s).groupBy("user_id").agg(F.min("event_id").alias("event_id")) for s in src], "user_id")


@query(r"""WITH t AS (SELECT DISTINCT id, unnest(regexp_extract_all(lower(title), '[\p{L}]{4,}')) AS w FROM reference),
u AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(title), '[\p{L}]{4,}')) AS w FROM jstor_meta)
SELECT id AS a, item_id AS b, count(*) AS shared FROM t JOIN u USING (w) GROUP BY 1, 2 HAVING count(*) >= 2""")
def shared_token_candidates(spark: SparkSession, d: str) -> DataFrame:
    words = lambda df, k, n: df.select(F.col(k).alias(n), F.explode(F.regexp_extract_all(F.lower("title"), F.lit(r"(\p{L}{4,})"), F.lit(1))).alias("token"))
    return O.shared_tokens(words(table(spark, d, "reference"), "id", "a"), words(table(spark, d, "jstor_meta"), "item_id", "b"))


@query("""WITH l AS (SELECT DISTINCT p_name FROM part WHERE p_size < 10), r AS (SELECT min(p_partkey) AS k, p_name AS other FROM part WHERE p_size >= 40 GROUP BY 2)
SELECT p_name, other, round(1 - levenshtein(p_name, other)::double / greatest(length(p_name), length(other)), 6) AS score FROM l JOIN r ON p_name <> other AND list_has_any(string_split(p_name, ' '), string_split(other, ' '))
QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY round(1 - levenshtein(p_name, other)::double / greatest(length(p_name), length(other)), 6) DESC, k) = 1""")
def best_match_first_wins(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.resolve import native_ratio

    p = table(spark, d, "part")
    words = lambda df, c: df.withColumn("w", F.explode(F.array_distinct(F.split(c, " "))))
    left = words(p.where("p_size < 10").select("p_name").distinct(), "p_name")
    right = words(p.where("p_size >= 40").groupBy(F.col("p_name").alias("other")).agg(F.min("p_partkey").alias("k")), "other")
    c = left.join(right, "w").where("p_name <> other").drop("w").distinct()
    c = c.select("p_name", "other", "k", F.round(native_ratio(F.col("p_name"), F.col("other")), 6).alias("score"))
    return O.best_match(c, "p_name", "score", "k").select("p_name", "other", "score")


@query("""SELECT (SELECT count(*) FROM documents WHERE coalesce(trim(text), '') <> '') AS filled, (SELECT count(*) FROM reference WHERE coalesce(trim(volume), '') = '') AS no_volume,
(SELECT count(*) FROM authors WHERE coalesce(trim(PPN_IDREF), '') <> '' OR coalesce(trim(orcid), '') <> '') AS any_id, (SELECT count(*) FROM reference WHERE year IS NOT NULL AND coalesce(trim(secondary_title), '') <> '') AS main,
(SELECT count(*) FROM reference WHERE year IS NULL OR coalesce(trim(secondary_title), '') = '') AS rest, (SELECT count(*) FROM reference WHERE fiabilite_dispo_jstor IS NULL OR fiabilite_dispo_jstor <= 0.9) AS confident,
(SELECT count(*) FROM reference WHERE NOT regexp_matches(coalesce(title, ''), '(?i)intro|preface|prologue|epilogue|abbrevia|conclu|index|appendix|rezension|review')) AS kept""")
def filter_suite(spark: SparkSession, d: str) -> DataFrame:
    r, c = table(spark, d, "reference"), lambda x: F.sum(x.cast("bigint"))
    doc = table(spark, d, "documents").agg(c(O.filled(F.col("text"))).alias("filled"))
    aut = table(spark, d, "authors").agg(c(O.any_filled("PPN_IDREF", "orcid")).alias("any_id"))
    main = F.col("year").isNotNull() & O.filled(F.col("secondary_title"))
    apparatus = F.coalesce("title", F.lit("")).rlike("(?i)intro|preface|prologue|epilogue|abbrevia|conclu|index|appendix|rezension|review")
    ref = r.agg(c(~O.filled(F.col("volume"))).alias("no_volume"), c(main).alias("main"), c(~main).alias("rest"), c(F.coalesce("fiabilite_dispo_jstor", F.lit(0.0)) <= 0.9).alias("confident"), c(~apparatus).alias("kept"))
    return doc.crossJoin(ref).crossJoin(aut).select("filled", "no_volume", "any_id", "main", "rest", "confident", "kept")  # one row each


@query("SELECT doc_id, CASE WHEN lower(trim(lang)) IN ('', 'und', 'na', 'nan', 'none', 'null', 'inconnu', 'unknown', 'undetermined', 'n/a', '-', '?') THEN NULL ELSE trim(lang) END AS lang, text IS NOT NULL AND length(text) BETWEEN 1 AND 100 AS short FROM documents")
def sentinel_nulls(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.identifiers import SENTINELS

    doc = table(spark, d, "documents")
    return doc.select("doc_id", O.blank_to_null(F.col("lang"), (*SENTINELS, "und")).alias("lang"), (F.col("text").isNotNull() & F.length("text").between(1, 100)).alias("short"))


@query("""SELECT reference.year, count(*) AS rows, count(DISTINCT language) AS languages, count(*) FILTER (WHERE k = 0) AS no_author, count(*) FILTER (WHERE k = 1) AS one_author, count(*) FILTER (WHERE k > 1) AS many_authors FROM reference
LEFT JOIN (SELECT reference_id, count(DISTINCT author_id) AS c FROM ecriture GROUP BY 1) e ON reference_id = reference.id, LATERAL (SELECT coalesce(c, 0) AS k) WHERE reference.year IS NOT NULL GROUP BY 1""")
def summary_suite(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "ecriture").groupBy("reference_id").agg(F.count_distinct("author_id").alias("c"))
    r = table(spark, d, "reference").where("year IS NOT NULL").join(e, F.col("reference_id") == F.col("id"), "left").withColumn("k", F.coalesce("c", F.lit(0)))
    s = lambda x: F.sum(x.cast("bigint"))
    return r.groupBy("year").agg(F.count("*").alias("rows"), F.count_distinct("language").alias("languages"), s(F.col("k") == 0).alias("no_author"), s(F.col("k") == 1).alias("one_author"), s(F.col("k") > 1).alias("many_authors"))


@query("SELECT doi, count(*) AS n, max(dispo_JSTOR) AS available, arg_max(fiabilite_dispo_jstor, (coalesce(dispo_JSTOR, -1), -id)) AS reliability, min(year) AS first_year FROM (SELECT *, regexp_replace(lower(trim(doi)), '^(https?://(dx\\.)?doi\\.org/|doi:)\\s*', '') AS k FROM reference) WHERE starts_with(k, '10.') GROUP BY doi HAVING count(*) > 1".replace("SELECT doi,", "SELECT k AS doi,").replace("GROUP BY doi", "GROUP BY k"))
def merge_maxima(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "reference").withColumn("k", T.doi_key(F.col("doi"))).where(F.col("k").startswith("10."))
    best = F.max(F.struct(F.coalesce("dispo_JSTOR", F.lit(-1)), -F.col("id"), "fiabilite_dispo_jstor"))["fiabilite_dispo_jstor"]
    return r.groupBy(F.col("k").alias("doi")).agg(F.count("*").alias("n"), F.max("dispo_JSTOR").alias("available"), best.alias("reliability"), F.min("year").alias("first_year")).where("n > 1")


@query(r"""WITH y AS (SELECT year(o_orderdate)::int AS y, count(*)::double AS n, sum(o_totalprice) AS total FROM orders GROUP BY 1)
SELECT y, round(pow(log10(n), 3.6), 6) AS width, greatest(2, round(1 + 3.22 * log10(n))::int) AS classes, round(1e6 * n / total, 2) AS rate, round(100 * n / sum(n) OVER (), 6) AS richness, (y // 10 * 10)::int || 's' AS decade FROM y""")
def scalar_math_suite(spark: SparkSession, d: str) -> DataFrame:
    y = orders(spark, d).groupBy("y").agg(F.count("*").cast("double").alias("n"), F.sum("o_totalprice").alias("total"))
    every = F.sum("n").over(Window.partitionBy())
    return y.select("y", F.round(F.pow(F.log10("n"), F.lit(3.6)), 6).alias("width"), O.sturges(F.col("n")).alias("classes"), F.round(1e6 * F.col("n") / F.col("total"), 2).alias("rate"), F.round(100 * F.col("n") / every, 6).alias("richness"), O.decade(F.col("y")).alias("decade"))


@query("""SELECT i.item_id, min(r.id) AS id FROM jstor_meta i LEFT JOIN (SELECT DISTINCT id, year, lower(trim(title)) AS t FROM reference) r ON r.t = lower(trim(i.title)) AND (r.year = try_cast(left(i.published_date, 4) AS int)) GROUP BY 1""")
def year_block_first_hit(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "reference").select("id", "year", F.lower(F.trim("title")).alias("t")).distinct()
    i = table(spark, d, "jstor_meta").select("item_id", F.lower(F.trim("title")).alias("t"), F.substring("published_date", 1, 4).try_cast("int").alias("year"))
    return i.join(r, ["t", "year"], "left").groupBy("item_id").agg(F.min("id").alias("id"))


@query("""SELECT a.id, coalesce(e.n, 0) AS links, coalesce(e.titles, 0) AS titles FROM authors a LEFT JOIN (SELECT author_id, count(*) AS n, count(DISTINCT title) AS titles FROM ecriture JOIN reference ON reference.id = reference_id GROUP BY 1) e ON e.author_id = a.id WHERE NOT EXISTS (SELECT 1 FROM suppressions s WHERE s.record_id = a.id AND lower(trim(table_cible)) = 'authors')""")
def titles_per_author(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "reference").select(F.col("id").alias("reference_id"), "title")
    e = table(spark, d, "ecriture").where("author_id IS NOT NULL").join(r, "reference_id").groupBy("author_id").agg(F.count("*").alias("links"), F.count_distinct("title").alias("titles"))
    gone = table(spark, d, "suppressions").where(F.lower(F.trim("table_cible")) == "authors").select(F.col("record_id").alias("id"))
    return table(spark, d, "authors").select("id").join(gone, "id", "left_anti").join(e, F.col("author_id") == F.col("id"), "left").select("id", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("titles", F.lit(0)).alias("titles"))


@query("""WITH c AS (SELECT o_orderpriority AS p, o_orderstatus AS s, count(*) AS n, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2)
SELECT p, s, n, (row_number() OVER (ORDER BY n DESC, round(v, 2) DESC, p, s))::int AS by_count, (row_number() OVER (ORDER BY length(p), p, s))::int AS by_length, (row_number() OVER (ORDER BY CASE s WHEN 'F' THEN 0 ELSE 1 END, s, p))::int AS by_label, (row_number() OVER (ORDER BY abs(n - 1000) DESC, p, s))::int AS by_abs FROM c""")
def sort_suite(spark: SparkSession, d: str) -> DataFrame:
    c = orders(spark, d).groupBy(F.col("o_orderpriority").alias("p"), F.col("o_orderstatus").alias("s")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("v"))
    r = lambda *o: F.row_number().over(Window.orderBy(*o))  # noqa: E731  # a small aggregate
    return c.select("p", "s", "n", r(F.desc("n"), F.round("v", 2).desc(), "p", "s").alias("by_count"), r(F.length("p"), "p", "s").alias("by_length"), r(F.when(F.col("s") == "F", 0).otherwise(1), "s", "p").alias("by_label"), r(F.abs(F.col("n") - 1000).desc(), "p", "s").alias("by_abs"))


@query("""WITH a AS (SELECT DISTINCT c_nationkey AS k FROM customer), b AS (SELECT DISTINCT s_nationkey AS k FROM supplier)
SELECT 'union' AS op, k FROM (SELECT k FROM a UNION SELECT k FROM b) UNION ALL SELECT 'intersect', k FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'except', k FROM (SELECT k FROM a EXCEPT SELECT k FROM b)""")
def set_suite(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).distinct()
    b = table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")).distinct()
    op = lambda name, df: df.select(F.lit(name).alias("op"), "k")
    return op("union", a.union(b).distinct()).unionAll(op("intersect", a.intersect(b))).unionAll(op("except", a.subtract(b)))


@query(r"""WITH x AS (SELECT id, unnest(list_filter(list_transform(string_split(replace(NomComplet, '&amp;', '&'), '&'), lambda s: trim(s)), lambda s: length(s) > 1)) AS name FROM authors WHERE contains(NomComplet, '&'))
SELECT id, name, trim(regexp_replace(split_part(name, ',', 1), '^[\s,*]+|[\s,*]+$', '', 'g')) AS family FROM x""")
def split_rows(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "authors").where(F.col("NomComplet").contains("&"))
    x = a.select("id", F.explode(T.split_names(F.col("NomComplet"))).alias("name"))
    return x.select("id", "name", T.name_parts(F.col("name"))["family"].alias("family"))


@query("""SELECT item_id, c.last_name AS last_name, c.first_name AS first_name FROM (SELECT item_id, unnest(creators) AS c FROM jstor_meta WHERE creators IS NOT NULL AND len(creators) > 0) UNION ALL SELECT item_id, NULL, NULL FROM jstor_meta WHERE creators IS NULL OR len(creators) = 0""")
def unnest_keep_empty(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "jstor_meta").select("item_id", F.explode_outer("creators").alias("c")).select("item_id", "c.last_name", "c.first_name")


@query("""SELECT user_id, arg_min(event_type, (ts, event_id)) AS first_type, arg_max(event_type, (ts, event_id)) AS last_type, count(*) AS n, arg_max(value, (ts, event_id)) FILTER (WHERE event_type <> 'error') AS last_value FROM events GROUP BY 1""")
def first_last_per_group(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("o", F.struct("ts", "event_id")).withColumn("ok", F.when(F.col("event_type") != "error", F.col("value")))
    return e.groupBy("user_id").agg(F.min_by("event_type", "o").alias("first_type"), F.max_by("event_type", "o").alias("last_type"), F.count("*").alias("n"), O.last_filled("o", "ok")[0].alias("last_value"))


@query("""SELECT year(ts) || '-' || lpad(month(ts)::varchar, 2, '0') || '-' || lpad(day(ts)::varchar, 2, '0') AS day, event_type, count(*) AS n, sum(CAST(json_extract(props, '$.k') AS bigint))::bigint AS k FROM events GROUP BY 1, 2""")
def json_extract_events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("n"), F.sum(F.from_json("props", "k bigint")["k"]).alias("k"))


@query("""SELECT o_orderpriority AS label, count(*) AS n, count(*) FILTER (WHERE o_orderkey % 7 = 0) AS preview FROM orders GROUP BY 1""")
def preview_counts(spark: SparkSession, d: str) -> DataFrame:
    return orders(spark, d).groupBy(F.col("o_orderpriority").alias("label")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderkey") % 7 == 0).alias("preview"))


@query()
def hash_split_sizes(spark: SparkSession, d: str) -> DataFrame:
    """A stable 75/25 split; tested for stability and share in pytest."""
    return table(spark, d, "documents").groupBy((O.hash_split(F.col("doc_id")) < 3).alias("training")).agg(F.count("*").alias("n"))


@query("""SELECT id, CASE WHEN lower(trim(PPN_IDREF)) IN ('', 'na', 'nan', 'none', 'null', 'inconnu', 'unknown', 'undetermined', 'n/a', '-', '?') OR regexp_matches(trim(PPN_IDREF), '^[0\\s.-]+$') THEN NULL ELSE trim(PPN_IDREF) END AS value FROM authors""".replace("\\\\", "\\"))
def identifier_presence(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "authors").select("id", present(F.col("PPN_IDREF")).alias("value"))


@query("""WITH c AS (SELECT coalesce(nullif(trim(language), ''), 'Inconnu') AS label, count(*) AS n FROM reference GROUP BY 1), t AS (SELECT * FROM c ORDER BY n DESC, label LIMIT 9)
SELECT label, n FROM t WHERE label <> 'Inconnu' ORDER BY n DESC, label LIMIT 8""")
def top9_minus_unknown(spark: SparkSession, d: str) -> DataFrame:
    """The nine most frequent labels, of these the first eight that are known: the order of the two steps matters."""
    c = table(spark, d, "reference").groupBy(F.coalesce(F.nullif(F.trim("language"), F.lit("")), F.lit("Inconnu")).alias("label")).agg(F.count("*").alias("n"))
    return c.orderBy(F.desc("n"), "label").limit(9).where("label <> 'Inconnu'").orderBy(F.desc("n"), "label").limit(8)


@query("SELECT COLUMNS(lambda c: NOT starts_with(c, 'date_')) FROM reference")
def projection_by_prefix(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "reference")
    return r.select(*[c for c in r.columns if not c.startswith("date_")])


@query("""WITH v AS (SELECT doc_id, lower(left(lang, 2)) AS a, CASE WHEN doc_id % 5 = 0 THEN 'fr' ELSE lower(left(lang, 2)) END AS b FROM documents WHERE lang IS NOT NULL)
SELECT CASE WHEN a = b THEN 'agreed' ELSE 'conflict' END AS source, count(*) AS n, round(100.0::double * count(*) / sum(count(*)) OVER (), 6) AS share FROM v GROUP BY 1""")
def agreement_tally(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "documents").where("lang IS NOT NULL").select(F.lower(F.substring("lang", 1, 2)).alias("a"), F.when(F.col("doc_id") % 5 == 0, "fr").otherwise(F.lower(F.substring("lang", 1, 2))).alias("b"))
    t = v.groupBy(F.when(F.col("a") == F.col("b"), "agreed").otherwise("conflict").alias("source")).agg(F.count("*").alias("n"))
    return t.crossJoin(F.broadcast(t.agg(F.sum("n").alias("_t")))).select("source", "n", F.round(100 * F.col("n") / F.col("_t"), 6).alias("share"))  # one row
