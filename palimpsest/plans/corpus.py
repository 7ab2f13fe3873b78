"""Lexicometry, graphs, statistics and models over the corpus and the database."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph as G
from ..operators import lexico as L
from ..operators import models as M
from ..operators import stats as S
from ..operators import tabular as O
from ..session import cut, table
from .registry import Registry

query = Registry()
QUERIES, SQL = query.queries, query.sql

# tokens of the annotated corpus, in DuckDB
_TOK = "tok AS (SELECT doc_id, year, f.token AS token, f.lemma AS lemma, f.pos AS pos, i - 1 AS pl FROM (SELECT doc_id, year, unnest(lexical_features) AS f, generate_subscripts(lexical_features, 1) AS i FROM corpus_propre))"
_LEM = "lem AS (SELECT doc_id, year, lower(lemma) AS term FROM tok WHERE regexp_matches(lemma, '^\\p{L}+$') AND length(lemma) >= 3 AND pos NOT IN ('PUNCT', 'NUM', 'SPACE', 'SYM', 'X'))"
_WORD = "word AS (SELECT doc_id, lang, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS token FROM documents)"


# English stop words.
STOP_WORDS = (
    "about", "above", "after", "again", "against", "all", "also", "and", "any", "are", "because", "been", "before", "being", "below", "between", "both", "but", "can", "did", "does", "doing", "down", "during", "each", "few", "for", "from", "further",
    "had", "has", "have", "having", "her", "here", "hers", "herself", "him", "himself", "his", "how", "into", "its", "itself", "just", "may", "more", "most", "nor", "not", "now", "off", "once", "one", "only", "other", "our", "ours", "out", "over", "own",
    "same", "she", "should", "some", "such", "than", "that", "the", "their", "theirs", "them", "themselves", "then", "there", "these", "they", "this", "those", "through", "too", "under", "until", "very", "was", "were", "what", "when", "where", "which", "while", "who", "whom", "why", "will", "with", "would", "you", "your",
)
_LEM = _LEM[:-1] + " AND lower(lemma) NOT IN (" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "))"


def toks(spark: SparkSession, d: str) -> DataFrame:
    return L.tokens(table(spark, d, "corpus_propre"), "lexical_features", "doc_id", "year")


def lemmas(spark: SparkSession, d: str) -> DataFrame:
    return L.content(toks(spark, d).where("pos IS NOT NULL"), stop=STOP_WORDS).withColumn("term", F.lower("lemma"))


def doc_words(spark: SparkSession, d: str) -> DataFrame:
    return L.words(table(spark, d, "documents"), "doc_id", "text", "lang")


@query(f"WITH {_TOK}, {_LEM} SELECT term, count(*) AS n FROM lem GROUP BY 1 ORDER BY n DESC, term LIMIT 50")
def token_frequencies_topk(spark: SparkSession, d: str) -> DataFrame:
    return L.frequencies(lemmas(spark, d), "term").orderBy(F.desc("n"), "term").limit(50)


@query(f"WITH {_WORD}, c AS (SELECT lang, token, count(*) AS n FROM word GROUP BY 1, 2) SELECT lang, sum(n)::bigint AS total, count(*) AS types, count(*) FILTER (WHERE n = 1) AS hapax, round(100.0::double * count(*) / sum(n), 6) AS richness FROM c GROUP BY 1")
def hapax_types_by_group(spark: SparkSession, d: str) -> DataFrame:
    return L.group_sizes(L.frequencies(doc_words(spark, d), "token", "lang"), "lang").withColumn("richness", F.round("richness", 6))


@query(f"""WITH {_TOK}, {_LEM}, c AS (SELECT doc_id, count(*) AS n, count(DISTINCT term) AS types FROM lem GROUP BY 1)
SELECT count(*) AS docs, round(avg(n), 6) AS mean, median(n) AS median, min(n) AS least, max(n) AS largest, quantile_cont(n, 0.25) AS q1, quantile_cont(n, 0.75) AS q3, round(100 - 100.0::double * sum(n) / (SELECT count(*) FROM tok), 6) AS reduction FROM c""")
def corpus_statistics(spark: SparkSession, d: str) -> DataFrame:
    c = lemmas(spark, d).groupBy("doc_id").agg(F.count("*").alias("n"))
    every = toks(spark, d).agg(F.count("*").alias("every"))
    s = c.agg(F.count("*").alias("docs"), F.avg("n").alias("mean"), F.percentile("n", F.lit(0.5)).alias("median"), F.min("n").alias("least"), F.max("n").alias("largest"), F.percentile("n", F.lit(0.25)).alias("q1"), F.percentile("n", F.lit(0.75)).alias("q3"), F.sum("n").alias("kept"))
    return s.crossJoin(every).select("docs", F.round("mean", 6).alias("mean"), "median", "least", "largest", "q1", "q3", F.round(100 - 100.0 * F.col("kept") / F.col("every"), 6).alias("reduction"))  # one row each


@query(f"""WITH {_WORD}, c AS (SELECT token, count(*) AS n FROM word GROUP BY 1), r AS (SELECT token, n, (row_number() OVER (ORDER BY n DESC, token))::int AS rank FROM c)
SELECT token, n, rank, round(max(n) OVER ()::double / rank, 6) AS predicted, round(n - max(n) OVER ()::double / rank, 6) AS difference, round(100.0::double * n / (max(n) OVER ()::double / rank), 6) AS percent FROM r WHERE rank <= 200""")
def zipf_table(spark: SparkSession, d: str) -> DataFrame:
    return L.zipf(L.frequencies(doc_words(spark, d), "token"), "token", 200).withColumns({c: F.round(c, 6) for c in ("predicted", "difference", "percent")})


@query(f"""WITH {_TOK}, {_LEM}, c AS (SELECT term, try_cast(year AS int) AS y, count(*) AS n FROM lem WHERE try_cast(year AS int) IS NOT NULL GROUP BY 1, 2), t AS (SELECT term, sum(n) AS total FROM c GROUP BY 1 HAVING sum(n) >= 2 ORDER BY total DESC, term LIMIT 100)
SELECT term, y, n, round(n::double / total, 6) AS profile FROM c JOIN t USING (term)""")
def contingency_and_profile(spark: SparkSession, d: str) -> DataFrame:
    c = lemmas(spark, d).withColumn("y", F.col("year").try_cast("int")).where("y IS NOT NULL").groupBy("term", "y").agg(F.count("*").alias("n"))
    return L.contingency(c, "term", "y", 2, 100).withColumn("profile", F.round("profile", 6))


@query(f"""WITH {_TOK}, {_LEM}, c AS (SELECT doc_id, term, count(*) AS n FROM lem GROUP BY 1, 2), f AS (SELECT term, count(*) AS df FROM c GROUP BY 1 HAVING count(*) >= 3),
w AS (SELECT doc_id, term, n * (ln((1 + (SELECT count(DISTINCT doc_id) FROM c))::double / (1 + df)) + 1) AS w FROM c JOIN f USING (term)), s AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY 1),
r AS (SELECT doc_id, term, round(w / norm, 5) AS tfidf FROM w JOIN s USING (doc_id))
SELECT doc_id, term, tfidf, (row_number() OVER (PARTITION BY doc_id ORDER BY tfidf DESC, term))::int AS rank FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY tfidf DESC, term) <= 20""")
def tfidf_top20(spark: SparkSession, d: str) -> DataFrame:
    t = L.tfidf(L.frequencies(lemmas(spark, d), "term", "doc_id"), "doc_id", "term").withColumn("tfidf", F.round("tfidf", 5))
    return O.top_k(t, 20, [F.desc("tfidf"), F.col("term")], "doc_id")


@query(f"""WITH {_WORD}, c AS (SELECT lang, token, count(*) AS n FROM word WHERE lang IS NOT NULL GROUP BY 1, 2), s AS (SELECT lang, sum(n) AS size FROM c GROUP BY 1), f AS (SELECT token, sum(n) AS f FROM c GROUP BY 1 HAVING sum(n) >= 5),
r AS (SELECT lang, token, round(n::double / size * ln(1 + (SELECT avg(size) FROM s) / f), 7) AS score FROM c JOIN s USING (lang) JOIN f USING (token))
SELECT lang, token, score FROM r QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, token) <= 15""")
def class_tfidf(spark: SparkSession, d: str) -> DataFrame:
    w = doc_words(spark, d).where("lang IS NOT NULL")
    s = L.class_tfidf(L.frequencies(w, "token", "lang"), "lang", "token", 5).withColumn("score", F.round("score", 7))
    return O.top_k(s, 15, [F.desc("score"), F.col("token")], "lang").drop("rank")


@query("""WITH d AS (SELECT doc_id, list_transform(lexical_features, lambda f: f.token) AS t FROM corpus_propre WHERE len(lexical_features) > 0), k AS (SELECT doc_id, t, unnest(list_filter(range(1, len(t) + 1), lambda i: lower(t[i]) = 'frontier')) AS i FROM d)
SELECT doc_id, (i - 1)::int AS at_, array_to_string(t[greatest(1, i - 8):i - 1], ' ') AS "left", t[i] AS keyword, array_to_string(t[i + 1:i + 8], ' ') AS "right" FROM k""")
def kwic_window8(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "corpus_propre").select("doc_id", F.transform("lexical_features", lambda f: f["token"]).alias("tokens"))
    return L.kwic(c, "frontier").withColumnRenamed("at", "at_")


@query(f"""WITH {_TOK}, y AS (SELECT *, lower(lemma) AS t FROM tok WHERE year IS NOT NULL), a AS (SELECT year, count(*) AS total FROM y GROUP BY 1), w AS (SELECT unnest(['frontier', 'barbarian', 'treaty']) AS t),
n AS (SELECT year, t, count(*) AS n, count(DISTINCT doc_id) AS docs FROM y GROUP BY 1, 2)
SELECT year, t, total, coalesce(n, 0) AS n, coalesce(docs, 0) AS docs, round(1e6 * coalesce(n, 0) / total, 2) AS per_million FROM a CROSS JOIN w LEFT JOIN n USING (year, t)""")
def term_rate_per_million(spark: SparkSession, d: str) -> DataFrame:
    y = toks(spark, d).where("year IS NOT NULL").withColumn("t", F.lower("lemma"))
    return L.progression(y, "year", "doc_id", "t", ["frontier", "barbarian", "treaty"])


@query(f"""WITH {_TOK}, u AS (SELECT token, count(*) AS n FROM tok WHERE token IS NOT NULL GROUP BY 1), b AS (SELECT token AS a, lead(token) OVER (PARTITION BY doc_id ORDER BY pl) AS b FROM tok), p AS (SELECT a, b, count(*) AS n FROM b WHERE b IS NOT NULL AND a IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 4),
s AS (SELECT p.a, p.b, p.n, log2(p.n::double * (SELECT sum(n) FROM u) / (x.n::double * y.n)) AS pmi FROM p JOIN u x ON x.token = p.a JOIN u y ON y.token = p.b WHERE least(x.n, y.n) <= (SELECT quantile_cont(n, 0.999) FROM u))
SELECT a, b, n, round(pmi, 6) AS pmi FROM s WHERE pmi >= 8""")
def bigram_pmi(spark: SparkSession, d: str) -> DataFrame:
    return L.pmi(toks(spark, d), "doc_id", floor=8.0).withColumn("pmi", F.round("pmi", 6))


_HY = "[-‐‑‒–—⁃]"
_ORD = "'first','second','third','fourth','fifth','sixth','seventh','eighth','ninth','tenth','eleventh','twelfth','thirteenth','fourteenth','fifteenth','sixteenth','seventeenth','eighteenth','nineteenth','twentieth'"


@query(f"""WITH {_TOK}, b AS (SELECT doc_id, pl, token AS t1, lead(token) OVER (PARTITION BY doc_id ORDER BY pl) AS t2 FROM tok), c AS (SELECT *, regexp_replace(t1, '{_HY}$', '') AS s FROM b WHERE regexp_matches(t1, '^.+{_HY}$') AND regexp_matches(t2, '^[a-zA-ZÀ-ÿ]'))
SELECT doc_id, pl::int AS at_, t1, t2, s || t2 AS merged FROM c WHERE NOT (ends_with(lower(s), 'eenth') OR lower(s) = 'anglo' OR (lower(s) IN ({_ORD}) AND lower(t2) IN ({_ORD}, 'century')))""")
def hyphen_merge_candidates(spark: SparkSession, d: str) -> DataFrame:
    return L.hyphen_candidates(toks(spark, d), "doc_id").withColumnRenamed("at", "at_")


@query(f"""WITH {_TOK}, b AS (SELECT doc_id, pl, token AS t1, lead(token) OVER (PARTITION BY doc_id ORDER BY pl) AS t2 FROM tok), c AS (SELECT *, regexp_replace(t1, '{_HY}$', '') || t2 AS merged FROM b WHERE regexp_matches(t1, '^.+{_HY}$') AND regexp_matches(t2, '^[a-zA-ZÀ-ÿ]') AND NOT (ends_with(lower(regexp_replace(t1, '{_HY}$', '')), 'eenth') OR lower(regexp_replace(t1, '{_HY}$', '')) = 'anglo' OR (lower(regexp_replace(t1, '{_HY}$', '')) IN ({_ORD}) AND lower(t2) IN ({_ORD}, 'century')))),
n AS (SELECT t1, t2, merged, count(*) AS n FROM c WHERE NOT regexp_matches(substr(merged, 2), '\\p{{Lu}}') GROUP BY 1, 2, 3) SELECT t1, t2, arg_min(merged, (-n, merged)) AS merged FROM n GROUP BY 1, 2""")
def general_merges(spark: SparkSession, d: str) -> DataFrame:
    return L.general_merges(L.hyphen_candidates(toks(spark, d), "doc_id"))


@query(f"WITH {_TOK} SELECT token, count(*) AS n FROM tok WHERE length(token) > 14 AND regexp_matches(token, '^\\p{{L}}+$') GROUP BY 1")
def long_tokens(spark: SparkSession, d: str) -> DataFrame:
    return L.long_tokens(toks(spark, d), fixed=14)


@query(f"""WITH {_WORD}, c AS (SELECT token, count(*) AS n FROM word GROUP BY 1)
SELECT CASE WHEN n = 1 THEN '1' WHEN n <= 4 THEN '2-4' WHEN n <= 9 THEN '5-9' WHEN n <= 19 THEN '10-19' WHEN n <= 49 THEN '20-49' ELSE '50+' END AS bucket, count(*) AS types, sum(n)::bigint AS places FROM c GROUP BY 1""")
def freq_buckets(spark: SparkSession, d: str) -> DataFrame:
    c = L.frequencies(doc_words(spark, d), "token")
    return c.groupBy(O.frequency_bucket(F.col("n")).alias("bucket")).agg(F.count("*").alias("types"), F.sum("n").alias("places"))


@query(f"""WITH {_TOK}, c AS (SELECT doc_id, token AS t1, lead(token) OVER (PARTITION BY doc_id ORDER BY pl) AS t2, pl FROM tok), h AS (SELECT * FROM c WHERE regexp_matches(t1, '^.+{_HY}$') AND regexp_matches(t2, '^[a-zA-ZÀ-ÿ]')),
t AS (SELECT doc_id, count(*) AS tokens FROM tok GROUP BY 1), p AS (SELECT doc_id, count(*) AS problems FROM h GROUP BY 1)
SELECT doc_id, tokens, problems, round(problems::double / tokens, 6) AS score FROM t JOIN p USING (doc_id) ORDER BY problems::double / tokens DESC, doc_id LIMIT 30""")
def noise_scores(spark: SparkSession, d: str) -> DataFrame:
    t = toks(spark, d)
    b = L.bigrams(t, "doc_id").where(T.broken(F.col("a")) & T.next_word(F.col("b")))
    return L.noise_scores(b, t, "doc_id").withColumn("score", F.round("score", 6))


@query("""WITH s AS (SELECT * FROM (VALUES ('the author', 'frame'), ('l’auteur', 'frame'), ('copied at', 'source'), ('copié à', 'source')) v(segment, category)), t AS (SELECT doc_id, lower(trim(regexp_replace(text, '[\\s\\x{00a0}\\x{2000}-\\x{200a}\\x{202f}\\x{3000}\\x{85}]+', ' ', 'g'))) AS t FROM documents WHERE text IS NOT NULL)
SELECT doc_id, category, sum((length(t) - length(replace(t, segment, ''))) // length(segment))::bigint AS n FROM t, s GROUP BY 1, 2 HAVING sum((length(t) - length(replace(t, segment, ''))) // length(segment)) > 0""")
def contained_segment_counts(spark: SparkSession, d: str) -> DataFrame:
    s = spark.createDataFrame([("the author", "frame"), ("l’auteur", "frame"), ("copied at", "source"), ("copié à", "source")], "segment string, category string")
    return L.segment_counts(table(spark, d, "documents").where("text IS NOT NULL"), "doc_id", "text", s)


@query(f"""WITH {_TOK}, w AS (SELECT doc_id, pl, token, list(token) OVER (PARTITION BY doc_id ORDER BY pl ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS l, list(token) OVER (PARTITION BY doc_id ORDER BY pl ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING) AS r FROM tok)
SELECT doc_id, pl::int AS at_, coalesce(array_to_string(l, ' '), '') AS "left", coalesce(array_to_string(r, ' '), '') AS "right" FROM w WHERE token = 'treaty'""")
def context_window(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("at")
    t = toks(spark, d).withColumns({"left": F.array_join(F.collect_list("token").over(w.rowsBetween(-5, -1)), " "), "right": F.array_join(F.collect_list("token").over(w.rowsBetween(1, 6)), " ")})
    return t.where("token = 'treaty'").select("doc_id", F.col("at").alias("at_"), "left", "right")


@query(f"""WITH {_TOK}, y AS (SELECT DISTINCT try_cast(year AS int) AS y FROM corpus_propre WHERE try_cast(year AS int) IS NOT NULL), g AS (SELECT unnest(range(min(y), max(y) + 1))::int AS y FROM y), t AS (SELECT try_cast(year AS int) AS y, count(*) AS tokens, count(DISTINCT doc_id) AS docs FROM tok GROUP BY 1), b AS (SELECT year AS y, count(*) AS base FROM reference GROUP BY 1)
SELECT y, coalesce(tokens, 0) AS tokens, coalesce(docs, 0) AS docs, coalesce(base, 0) AS base, (sum(coalesce(tokens, 0)) OVER (ORDER BY y ROWS UNBOUNDED PRECEDING))::bigint AS running FROM g LEFT JOIN t USING (y) LEFT JOIN b USING (y)""")
def dtm_and_coverage(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "corpus_propre").select(F.col("year").try_cast("int").alias("y")).where("y IS NOT NULL")
    t = toks(spark, d).groupBy(F.col("year").try_cast("int").alias("y")).agg(F.count("*").alias("tokens"), F.count_distinct("doc_id").alias("docs"))
    b = table(spark, d, "reference").groupBy(F.col("year").alias("y")).agg(F.count("*").alias("base"))
    g = O.calendar(c, "y").join(t, "y", "left").join(b, "y", "left").na.fill(0)
    return g.withColumn("running", O.running_sum("tokens", "y"))


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, 'the\s*author', 'theauthor', 'g'), 'of\s*the', 'ofthe', 'g'), 'la\s*région', 'larégion', 'g') AS text FROM documents WHERE text IS NOT NULL""")
def merge_fold_text(spark: SparkSession, d: str) -> DataFrame:
    """Decided merges, made in the texts of all documents."""
    m = F.array(*[F.struct(F.lit(x).alias("t1"), F.lit(y).alias("t2"), F.lit(x + y).alias("merged")) for x, y in (("the", "author"), ("of", "the"), ("la", "région"))])
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", T.merge_text(F.col("text"), m).alias("text"))


@query("SELECT doc_id, '**** *YEAR_' || coalesce(year, '') || ' *DOC_' || left(replace(trim(regexp_replace(coalesce(title, ''), '[\\r\\n\\t]+', ' ', 'g')), ' ', '_'), 50) || chr(10) || coalesce(array_to_string(list_transform(lexical_features, lambda f: f.token), ' '), '') || chr(10) AS entry FROM corpus_propre")
def iramuteq_entries(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "corpus_propre").withColumn("text", F.array_join(F.transform("lexical_features", lambda f: f["token"]), " "))
    return c.select("doc_id", L.iramuteq(c).alias("entry"))


# graphs: authors joined by publications

_LINK = "link AS (SELECT DISTINCT author_id AS a, reference_id AS p FROM ecriture JOIN authors ON authors.id = author_id JOIN reference ON reference.id = reference_id WHERE author_id <> 1)"
_CO = "co AS (SELECT x.a AS u, y.a AS v, count(*) AS weight FROM link x JOIN link y ON x.p = y.p AND x.a < y.a GROUP BY 1, 2)"
_CC = "both_ AS (SELECT u, v FROM co UNION SELECT v, u FROM co), reach AS (SELECT u AS a, v AS b FROM both_ UNION SELECT r.a, s.v FROM reach r JOIN both_ s ON s.u = r.b), cc AS (SELECT a AS id, min(least(a, b)) AS component FROM reach GROUP BY 1)"


def links(spark: SparkSession, d: str) -> DataFrame:
    a, r = table(spark, d, "authors").select(F.col("id").alias("author_id")), table(spark, d, "reference").select(F.col("id").alias("reference_id"), "year")
    e = table(spark, d, "ecriture").where("author_id <> 1").select("author_id", "reference_id").distinct()
    return e.join(a, "author_id", "left_semi").join(r, "reference_id")


def coauthors(spark: SparkSession, d: str) -> DataFrame:
    return G.project(links(spark, d), "author_id", "reference_id")


@query(f"WITH {_LINK}, {_CO} SELECT u, v, weight FROM co")
def bipartite_projection_simple(spark: SparkSession, d: str) -> DataFrame:
    return coauthors(spark, d)


@query(f"WITH {_LINK}, k AS (SELECT p, count(*) AS k FROM link GROUP BY 1) SELECT x.a AS u, y.a AS v, round(sum(1.0::double / (k - 1)), 6) AS weight FROM link x JOIN link y ON x.p = y.p AND x.a < y.a JOIN k ON k.p = x.p AND k > 1 GROUP BY 1, 2")
def bipartite_projection_newman(spark: SparkSession, d: str) -> DataFrame:
    return G.project(links(spark, d), "author_id", "reference_id", True).withColumn("weight", F.round("weight", 6))


@query(f"WITH RECURSIVE {_LINK}, {_CO}, {_CC} SELECT id, component FROM cc")
def connected_components_min_label(spark: SparkSession, d: str) -> DataFrame:
    return G.components(coauthors(spark, d))


@query(f"""WITH RECURSIVE {_LINK}, {_CO}, {_CC}, n AS (SELECT count(*) AS n FROM (SELECT DISTINCT a FROM link)), s AS (SELECT component, count(*) AS k FROM cc GROUP BY 1)
SELECT n AS nodes, (SELECT count(*) FROM co) AS edges, round(2.0 * (SELECT count(*) FROM co) / (n::double * (n - 1)), 9) AS density, (SELECT count(*) FROM s) + n - (SELECT sum(k) FROM s)::bigint AS components, (SELECT max(k) FROM s) AS lcc_size,
round(100.0::double * (SELECT max(k) FROM s) / n, 6) AS lcc_share, round(2.0::double * (SELECT count(*) FROM co) / n, 6) AS mean_degree, round(2.0::double * (SELECT sum(weight) FROM co) / n, 6) AS mean_weighted_degree FROM n""")
def lcc_share_density_degree(spark: SparkSession, d: str) -> DataFrame:
    l = links(spark, d)
    m = G.global_metrics(cut(coauthors(spark, d)), l.select(F.col("author_id").alias("id")).distinct())
    return m.withColumns({"density": F.round("density", 9), "lcc_share": F.round("lcc_share", 6), "mean_degree": F.round("mean_degree", 6), "mean_weighted_degree": F.round("mean_weighted_degree", 6)})


def _dated_pairs(spark: SparkSession, d: str) -> DataFrame:
    l = links(spark, d).where("year IS NOT NULL")
    return l.select(F.col("author_id").alias("u"), "reference_id", "year").join(l.select(F.col("author_id").alias("v"), "reference_id"), "reference_id").where("u < v").select("u", "v", "year", F.lit(1).alias("weight"))


@query(f"""WITH {_LINK}, pr AS (SELECT x.a AS u, y.a AS v, year FROM link x JOIN link y ON x.p = y.p AND x.a < y.a JOIN reference r ON r.id = x.p WHERE year IS NOT NULL), ys AS (SELECT unnest(range(min(year), max(year) + 1))::int AS year FROM pr),
e AS (SELECT year, count(*) AS c FROM (SELECT u, v, min(year) AS year FROM pr GROUP BY 1, 2) GROUP BY 1), w AS (SELECT year, count(*) AS c FROM pr GROUP BY 1), n AS (SELECT year, count(*) AS c FROM (SELECT a, min(year) AS year FROM (SELECT u AS a, year FROM pr UNION ALL SELECT v, year FROM pr) GROUP BY 1) GROUP BY 1),
s AS (SELECT year, (sum(coalesce(n.c, 0)) OVER o)::bigint AS nodes, (sum(coalesce(e.c, 0)) OVER o)::bigint AS edges, (sum(coalesce(w.c, 0)) OVER o)::bigint AS weight FROM ys LEFT JOIN e USING (year) LEFT JOIN w USING (year) LEFT JOIN n USING (year) WINDOW o AS (ORDER BY year ROWS UNBOUNDED PRECEDING))
SELECT year, nodes, edges, weight, round(CASE WHEN nodes > 0 THEN 2.0::double * edges / nodes END, 6) AS mean_degree FROM s""")
def cumulative_graph(spark: SparkSession, d: str) -> DataFrame:
    p = _dated_pairs(spark, d)
    return G.cumulative(p, "year", O.calendar(p, "year")).withColumn("mean_degree", F.round("mean_degree", 6))


@query(f"WITH {_LINK}, {_CO}, n AS (SELECT a, count(*) AS k FROM (SELECT u AS a FROM co UNION ALL SELECT v FROM co) GROUP BY 1) SELECT DISTINCT link.a AS id, coalesce(k, 1) AS partners FROM link LEFT JOIN n USING (a)")
def coauthor_counts(spark: SparkSession, d: str) -> DataFrame:
    return G.partners(links(spark, d), "author_id", "reference_id")


@query(f"""WITH {_LINK}, {_CO}, t AS (SELECT x.u AS a, x.v AS b, y.v AS c, pow(x.weight::double * y.weight * z.weight / pow((SELECT max(weight) FROM co)::double, 3), 1 / 3.0::double) AS t FROM co x JOIN co y ON y.u = x.v JOIN co z ON z.u = x.u AND z.v = y.v),
v AS (SELECT id, sum(t) AS t FROM (SELECT a AS id, t FROM t UNION ALL SELECT b, t FROM t UNION ALL SELECT c, t FROM t) GROUP BY 1), k AS (SELECT id, count(*) AS k FROM (SELECT u AS id FROM co UNION ALL SELECT v FROM co) GROUP BY 1)
SELECT id, round(CASE WHEN k < 2 THEN 0 ELSE 2 * coalesce(t, 0) / (k::double * (k - 1)) END, 6) AS clustering FROM k LEFT JOIN v USING (id)""")
def weighted_clustering(spark: SparkSession, d: str) -> DataFrame:
    return G.clustering(coauthors(spark, d)).withColumn("clustering", F.round("clustering", 6))


@query(f"WITH {_LINK}, {_CO}, k AS (SELECT id, count(*) AS degree, sum(weight)::bigint AS weighted_degree FROM (SELECT u AS id, weight FROM co UNION ALL SELECT v, weight FROM co) GROUP BY 1) SELECT id, degree, weighted_degree FROM k")
def degrees(spark: SparkSession, d: str) -> DataFrame:
    return G.degrees(coauthors(spark, d))


@query()
def betweenness_closeness_diameter(spark: SparkSession, d: str) -> DataFrame:
    """Path centralities of every author; the largest eccentricity in a component is its diameter. Tested in pytest."""
    return G.path_centralities(cut(coauthors(spark, d))).withColumns({c: F.round(c, 9) for c in ("betweenness", "closeness", "harmonic")})


@query()
def pagerank(spark: SparkSession, d: str) -> DataFrame:
    return G.pagerank(cut(coauthors(spark, d))).withColumn("pagerank", F.round("pagerank", 7))


@query()
def eigenvector(spark: SparkSession, d: str) -> DataFrame:
    return G.eigenvector(cut(coauthors(spark, d))).withColumn("eigenvector", F.round("eigenvector", 5))


@query()
def katz(spark: SparkSession, d: str) -> DataFrame:
    return G.katz(cut(coauthors(spark, d))).withColumn("katz", F.round("katz", 5))


@query()
def lcc_entry_years(spark: SparkSession, d: str, start: int = 1980, least: int = 3) -> DataFrame:
    """The year each author enters the largest component. The reference's start is 2000, its least size 200.
    Tested in pytest."""
    p = cut(_dated_pairs(spark, d).select("u", "v", F.col("year").cast("int").alias("year")))
    years = [r.year for r in p.select("year").distinct().collect()]
    return G.entry_periods(p, "year", years, start, least)


@query(f"WITH {_LINK}, {_CO}, k AS (SELECT id, count(*)::double AS x FROM (SELECT u AS id FROM co UNION ALL SELECT v FROM co) GROUP BY 1), r AS (SELECT x, row_number() OVER (ORDER BY x) AS i, count(*) OVER () AS n, sum(x) OVER () AS s FROM k) SELECT count(*) AS n, round(2 * sum(i * x) / (any_value(n) * any_value(s)) - (any_value(n) + 1) / any_value(n)::double, 6) AS gini FROM r")
def centrality_gini(spark: SparkSession, d: str) -> DataFrame:
    return S.gini(G.degrees(coauthors(spark, d)), "degree").withColumn("gini", F.round("gini", 6))


@query(f"""WITH RECURSIVE {_LINK}, {_CO}, {_CC}, big AS (SELECT component FROM cc GROUP BY 1 ORDER BY count(*) DESC, component LIMIT 1), k AS (SELECT id, count(*)::double AS degree FROM (SELECT u AS id FROM co UNION ALL SELECT v FROM co) GROUP BY 1),
y AS (SELECT a AS id, min(year)::double AS entry FROM link JOIN reference r ON r.id = p WHERE year IS NOT NULL GROUP BY 1), m AS (SELECT id, entry, degree FROM cc JOIN big USING (component) JOIN k USING (id) JOIN y USING (id)),
s AS (SELECT 'all' AS part, entry, degree FROM m UNION ALL SELECT 'top', entry, degree FROM m WHERE degree >= (SELECT quantile_cont(degree, 0.99) FROM m)),
r AS (SELECT part, rank() OVER (PARTITION BY part ORDER BY entry) + (count(*) OVER (PARTITION BY part, entry) - 1) / 2.0::double AS x, rank() OVER (PARTITION BY part ORDER BY degree) + (count(*) OVER (PARTITION BY part, degree) - 1) / 2.0::double AS y FROM s)
SELECT part, count(*) AS n, CASE WHEN count(*) >= 5 AND stddev_pop(x) > 0 AND stddev_pop(y) > 0 THEN round(corr(x, y), 6) END AS rho FROM r GROUP BY 1""")
def entry_year_centrality(spark: SparkSession, d: str) -> DataFrame:
    """Spearman's correlation of the first year of publication and the degree of the authors in the largest
    component, of all and of those in the top hundredth."""
    l, e = links(spark, d), cut(coauthors(spark, d))
    lcc = G.largest_component(G.components(e))
    y = l.where("year IS NOT NULL").groupBy(F.col("author_id").alias("id")).agg(F.min("year").cast("double").alias("entry"))
    m = cut(G.degrees(e).select("id", F.col("degree").cast("double").alias("degree")).join(lcc, "id", "left_semi").join(y, "id").select("entry", "degree"))
    top = m.join(F.broadcast(m.agg(F.percentile("degree", F.lit(0.99)).alias("q"))), F.col("degree") >= F.col("q")).select("entry", "degree")  # one row
    part = lambda x, name: S.spearman(x, ["entry", "degree"], p=False).select(F.lit(name).alias("part"), "n", F.round(F.when(~F.isnan("rho"), F.col("rho")), 6).alias("rho"))
    return part(m, "all").unionAll(part(top, "top"))


@query()
def lcc_diameter(spark: SparkSession, d: str) -> DataFrame:
    """(members, diameter) of the largest component: its largest eccentricity. Tested in pytest."""
    return G.diameter(coauthors(spark, d))


# statistics

@query("""WITH c AS (SELECT o_orderpriority AS a, o_orderstatus AS b, count(*) AS n FROM orders GROUP BY 1, 2), t AS (SELECT *, sum(n) OVER (PARTITION BY a) AS r, sum(n) OVER (PARTITION BY b) AS k, sum(n) OVER () AS total FROM c), e AS (SELECT *, r * k::double / total AS e FROM t)
SELECT a, b, n, round(e, 6) AS expected, round((n - e) / sqrt(e), 6) AS pearson, round((n - e) / sqrt(e * (1 - r / total::double) * (1 - k / total::double)), 6) AS adjusted, round(100 * ((n - e) * (n - e) / e) / sum((n - e) * (n - e) / e) OVER (), 6) AS share,
CASE WHEN (n - e) / sqrt(e * (1 - r / total::double) * (1 - k / total::double)) > 1.96 THEN 'over' WHEN (n - e) / sqrt(e * (1 - r / total::double) * (1 - k / total::double)) < -1.96 THEN 'under' ELSE 'ns' END AS status FROM e""")
def chi2_residuals(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("a"), F.col("o_orderstatus").alias("b"))
    r = S.residuals(S.contingency(o, "a", "b"))
    return r.select("a", "b", "n", *[F.round(c, 6).alias(c) for c in ("expected", "pearson", "adjusted", "share")], "status")


@query("""WITH c AS (SELECT o_orderpriority AS a, o_orderstatus AS b, count(*) AS n FROM orders GROUP BY 1, 2), t AS (SELECT *, sum(n) OVER (PARTITION BY a) AS r, sum(n) OVER (PARTITION BY b) AS k, sum(n) OVER () AS total FROM c)
SELECT round(sum(pow(n - r * k::double / total, 2) / (r * k::double / total)), 6) AS chi2, ((count(DISTINCT a) - 1) * (count(DISTINCT b) - 1)) AS dof, round(sqrt(sum(pow(n - r * k::double / total, 2) / (r * k::double / total)) / (any_value(total) * (least(count(DISTINCT a), count(DISTINCT b)) - 1))), 8) AS cramers_v FROM t""")
def chi2_cramer(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("a"), F.col("o_orderstatus").alias("b"))
    return S.chi_squared(S.contingency(o, "a", "b"), "a", "b", p=False).withColumns({"chi2": F.round("chi2", 6), "cramers_v": F.round("cramers_v", 8)})


@query()
def chi2_p_values(spark: SparkSession, d: str) -> DataFrame:
    """The test's p and each cell's two-sided p; numerics are tested against closed forms in pytest."""
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("a"), F.col("o_orderstatus").alias("b"))
    t = S.contingency(o, "a", "b")
    return S.with_normal_p(S.residuals(t)).select("a", "b", "p").unionByName(S.chi_squared(t, "a", "b").select(F.lit("all").alias("a"), F.lit("all").alias("b"), "p"))


@query("""WITH g AS (SELECT o_orderpriority AS g, o_totalprice AS x FROM orders), r AS (SELECT g, x, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::double AS r FROM g), s AS (SELECT g, sum(r) AS r, count(*) AS k FROM r GROUP BY 1), t AS (SELECT sum(pow(c, 3) - c) AS ties FROM (SELECT count(*)::double AS c FROM g GROUP BY x)), a AS (SELECT sum(r * r / k) AS s, sum(k)::double AS n, count(*) AS groups FROM s),
h AS (SELECT (12 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - ties / (pow(n, 3) - n)) AS h, groups, n::bigint AS n FROM a, t)
SELECT round(h, 4) AS h, groups, n, round(h / (n - 1), 8) AS epsilon2 FROM h""")
def kruskal_h_eps2(spark: SparkSession, d: str) -> DataFrame:
    return S.kruskal(table(spark, d, "orders"), "o_orderpriority", "o_totalprice", p=False).withColumns({"h": F.round("h", 4), "epsilon2": F.round("epsilon2", 8)})


_SP = ("l_quantity", "l_extendedprice", "l_discount")
_RANK = ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::double AS {c}" for c in _SP)


@query(f"""WITH r AS (SELECT {_RANK} FROM lineitem) SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, count(*) AS n, round(corr(l_quantity, l_extendedprice), 6) AS rho FROM r UNION ALL SELECT 'l_quantity', 'l_discount', count(*), round(corr(l_quantity, l_discount), 6) FROM r UNION ALL SELECT 'l_extendedprice', 'l_discount', count(*), round(corr(l_extendedprice, l_discount), 6) FROM r""")
def spearman_matrix(spark: SparkSession, d: str) -> DataFrame:
    return S.spearman(table(spark, d, "lineitem"), list(_SP), p=False).withColumn("rho", F.round("rho", 6))


@query("""WITH p AS (SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, corr(l_quantity, l_extendedprice) AS r FROM lineitem UNION ALL SELECT 'l_quantity', 'l_discount', corr(l_quantity, l_discount) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_discount', corr(l_extendedprice, l_discount) FROM lineitem)
SELECT a, b, round(r, 6) AS r, (row_number() OVER (ORDER BY abs(round(r, 6)) DESC, a, b))::int AS rank FROM p""")
def pearson_pairs_upper(spark: SparkSession, d: str) -> DataFrame:
    p = S.pearson_pairs(table(spark, d, "lineitem"), list(_SP)).withColumn("r", F.round("r", 6))
    return p.withColumn("rank", F.row_number().over(Window.orderBy(F.abs("r").desc(), "a", "b")))  # one row for each pair of columns


@query("""WITH x AS (SELECT c_acctbal AS x FROM customer WHERE c_acctbal > 0), r AS (SELECT x, row_number() OVER (ORDER BY x) AS i, count(*) OVER () AS n, sum(x) OVER () AS s FROM x), g AS (SELECT count(*) AS n, round(2 * sum(i * x) / (any_value(n) * any_value(s)) - (any_value(n) + 1) / any_value(n)::double, 6) AS gini FROM r),
l AS (SELECT part, round((SELECT sum(x) FROM r WHERE i <= floor(part * n / 10)) / (SELECT any_value(s) FROM r), 6) AS share FROM (SELECT unnest(range(1, 11))::int AS part), (SELECT count(*) AS n FROM x))
SELECT part, share, n, gini FROM l, g""")
def gini_lorenz(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    return S.lorenz(c, "c_acctbal").crossJoin(S.gini(c, "c_acctbal")).select("part", F.round("share", 6).alias("share"), "n", F.round("gini", 6).alias("gini"))  # one row


@query("""WITH c AS (SELECT user_id, event_type, count(*)::double AS n FROM events GROUP BY 1, 2), t AS (SELECT user_id, sum(n) AS t FROM c GROUP BY 1) SELECT user_id, round(sum(-n / t * ln(n / t)) / ln(5.0), 6) AS entropy FROM c JOIN t USING (user_id) GROUP BY 1""")
def row_entropy(spark: SparkSession, d: str) -> DataFrame:
    return S.entropy(table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n")), "user_id", "n", 5).withColumn("entropy", F.round("entropy", 6))


_EMB = "e AS (SELECT vec_id, label, unnest(embedding)::double AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings), m AS (SELECT label, dim, avg(x) AS m, count(*) AS n FROM e GROUP BY 1, 2)"


@query(f"WITH {_EMB} SELECT a.label AS a, b.label AS b, round(sum(a.m * b.m) / sqrt(sum(a.m * a.m) * sum(b.m * b.m)), 5) AS cosine FROM m a JOIN m b ON a.dim = b.dim AND a.label < b.label GROUP BY 1, 2")
def cosine_topic_pairs(spark: SparkSession, d: str) -> DataFrame:
    return S.cosine_pairs(S.mean_vectors(table(spark, d, "embeddings"), "label", "embedding"), "label").withColumn("cosine", F.round("cosine", 5))


@query(f"""WITH {_WORD}, c AS (SELECT lang, token, count(*) AS n FROM word WHERE lang IS NOT NULL GROUP BY 1, 2), t AS (SELECT lang, token FROM c QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, token) <= 20), k AS (SELECT lang, count(*) AS n FROM t GROUP BY 1)
SELECT a, b, shared, round(shared::double / (x.n + y.n - shared), 6) AS jaccard FROM (SELECT a.lang AS a, b.lang AS b, count(*) AS shared FROM t a JOIN t b ON a.token = b.token AND a.lang < b.lang GROUP BY 1, 2) JOIN k x ON x.lang = a JOIN k y ON y.lang = b""")
def jaccard_top_terms(spark: SparkSession, d: str) -> DataFrame:
    t = O.top_k(L.frequencies(doc_words(spark, d).where("lang IS NOT NULL"), "token", "lang"), 20, [F.desc("n"), F.col("token")], "lang")
    return S.jaccard_pairs(t, "lang", "token").withColumn("jaccard", F.round("jaccard", 6))


@query(f"""WITH {_EMB}, dd AS (SELECT vec_id, e.label, sum(pow(x - m, 2)) AS d2 FROM e JOIN m USING (label, dim) GROUP BY 1, 2), p AS (SELECT label, sum(d2) AS w, avg(sqrt(d2)) AS s, count(*) AS n FROM dd GROUP BY 1), g AS (SELECT dim, avg(x) AS g FROM e GROUP BY 1), bt AS (SELECT label, sum(n * pow(m - g, 2)) AS b FROM m JOIN g USING (dim) GROUP BY 1),
f AS (SELECT a.label AS a, b.label AS b, sqrt(sum(pow(a.m - b.m, 2))) AS d FROM m a JOIN m b ON a.dim = b.dim AND a.label <> b.label GROUP BY 1, 2), r AS (SELECT a, max((x.s + y.s) / d) AS r FROM f JOIN p x ON x.label = a JOIN p y ON y.label = b GROUP BY 1)
SELECT round((SELECT sum(b) FROM bt) / ((SELECT count(*) FROM p) - 1) / ((SELECT sum(w) FROM p) / ((SELECT sum(n) FROM p) - (SELECT count(*) FROM p))), 4) AS calinski_harabasz, round((SELECT avg(r) FROM r), 4) AS davies_bouldin""")
def ch_db(spark: SparkSession, d: str) -> DataFrame:
    return S.cluster_indices(table(spark, d, "embeddings"), "label", "embedding").select(F.round("calinski_harabasz", 4).alias("calinski_harabasz"), F.round("davies_bouldin", 4).alias("davies_bouldin"))


@query()
def silhouette(spark: SparkSession, d: str) -> DataFrame:
    return S.silhouette(table(spark, d, "embeddings"), "label", "embedding").select(F.round("silhouette", 6).alias("silhouette"))


@query("""WITH c AS (SELECT o_orderpriority AS k, count(*)::double AS x, round(avg(o_totalprice), 2) AS y FROM orders GROUP BY 1), r AS (SELECT k, rank() OVER (ORDER BY -x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::double + rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0::double AS rank_sum FROM c) SELECT k, rank_sum FROM r""")
def rank_sum_select(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("k")).agg(F.count("*").alias("x"), F.round(F.avg("o_totalprice"), 2).alias("y"))
    return S.rank_sum(c, "k", ["x"], ["y"])


# models

def _documents(spark: SparkSession, d: str) -> DataFrame:
    return lemmas(spark, d).groupBy("doc_id").agg(F.sort_array(F.collect_list("term")).alias("terms"))


@query()
def lda_topics(spark: SparkSession, d: str) -> DataFrame:
    model, vocabulary, _ = M.lda(_documents(spark, d), "doc_id", "terms", 5, passes=30)
    return M.topic_words(model, vocabulary, 10).withColumn("beta", F.round("beta", 6))


_FIXED = ((0, ("author", "question", "identity")), (1, ("land", "treaty", "frontier")), (2, ("century", "grave", "author")))


@query(f"""WITH {_TOK}, ft AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{w}')" for i, ws in _FIXED for w in ws)}) v(topic, term)), w AS (SELECT DISTINCT term FROM ft),
t AS (SELECT doc_id, pl, lower(lemma) AS term FROM tok WHERE lemma IS NOT NULL), len AS (SELECT doc_id, max(pl) AS last FROM t GROUP BY 1), tot AS (SELECT sum(greatest(1, last - 108)) AS n FROM len),
win AS (SELECT DISTINCT doc_id, term, unnest(range(least(greatest(0, pl - 109), greatest(0, least(pl, last - 109))), greatest(0, least(pl, last - 109)) + 1)) AS w FROM t JOIN len USING (doc_id) WHERE term IN (SELECT term FROM w)),
one AS (SELECT term, count(*) AS n FROM win GROUP BY 1), two AS (SELECT x.term AS a, y.term AS b, count(*) AS n FROM win x JOIN win y USING (doc_id, w) GROUP BY 1, 2),
v AS (SELECT x.topic, x.term AS a, y.term AS b, CASE WHEN x.term = y.term THEN 1.0::double ELSE coalesce(ln((coalesce(two.n, 0)::double / tot.n + 1e-12) / (oa.n::double / tot.n * ob.n::double / tot.n + 1e-12)) / -ln(coalesce(two.n, 0)::double / tot.n + 1e-12), 0) END AS x
  FROM ft x JOIN ft y ON x.topic = y.topic CROSS JOIN tot LEFT JOIN two ON two.a = x.term AND two.b = y.term LEFT JOIN one oa ON oa.term = x.term LEFT JOIN one ob ON ob.term = y.term),
s AS (SELECT topic, b, sum(x) AS y FROM v GROUP BY 1, 2)
SELECT topic, round(avg(c), 6) AS c_v FROM (SELECT topic, a, sum(x * y) / sqrt(sum(x * x) * sum(y * y)) AS c FROM v JOIN s USING (topic, b) GROUP BY 1, 2) GROUP BY 1""")
def fixed_topic_coherence(spark: SparkSession, d: str) -> DataFrame:
    """c_v of given topics, which SQL can follow."""
    topics = spark.createDataFrame([(i, w) for i, ws in _FIXED for w in ws], "topic int, term string")
    t = toks(spark, d).select("doc_id", "at", F.lower("lemma").alias("token")).where("token IS NOT NULL")
    return M.coherence(t, "doc_id", topics).withColumn("c_v", F.round("c_v", 6))


@query()
def topic_coherence(spark: SparkSession, d: str) -> DataFrame:
    model, vocabulary, _ = M.lda(_documents(spark, d), "doc_id", "terms", 5, passes=20)
    t = toks(spark, d).select("doc_id", "at", F.lower("lemma").alias("token")).where("token IS NOT NULL")
    return M.coherence(t, "doc_id", cut(M.topic_words(model, vocabulary, 8).select("topic", "term"))).withColumn("c_v", F.round("c_v", 6))


@query(f"""WITH {_EMB}, n AS (SELECT vec_id, e.label AS own, m.label, sum(x * m.m) / sqrt(sum(x * x) * sum(m.m * m.m)) AS c FROM e JOIN m USING (dim) GROUP BY 1, 2, 3), s AS (SELECT vec_id, label, round(exp(4 * c) / sum(exp(4 * c)) OVER (PARTITION BY vec_id), 5) AS g FROM n),
a AS (SELECT vec_id, arg_max(label, (g, -label)) AS major, string_agg(label::varchar, ',' ORDER BY label) FILTER (WHERE g >= 0.15) AS over_ FROM s GROUP BY 1) SELECT vec_id, major, coalesce(over_, major::varchar) AS topics FROM a""")
def topic_assignment(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("dim", "x"))
    m = S.mean_vectors(table(spark, d, "embeddings"), "label", "embedding")
    c = e.join(F.broadcast(m), "dim").groupBy("vec_id", "label").agg((F.sum(F.col("x") * F.col("mean")) / F.sqrt(F.sum(F.col("x") * F.col("x")) * F.sum(F.col("mean") * F.col("mean")))).alias("c"))  # labels x dimensions rows are broadcast
    g = c.withColumn("g", F.round(F.exp(4 * F.col("c")) / F.sum(F.exp(4 * F.col("c"))).over(Window.partitionBy("vec_id")), 5))
    g = g.groupBy("vec_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("label", "g"))), lambda s: s["g"]).alias("gamma"))
    return L.assign_topics(g).select("vec_id", "major", F.array_join("topics", ",").alias("topics"))


@query()
def gamma_analysis(spark: SparkSession, d: str) -> DataFrame:
    """(topic, dominant, mean, entropy): documents that a topic dominates, its mean share, and the mean entropy of
    these documents."""
    _, _, gamma = M.lda(_documents(spark, d), "doc_id", "terms", 4, passes=30)
    long = gamma.select("doc_id", F.posexplode("gamma").alias("topic", "g"))
    h = S.entropy(long, "doc_id", "g", 4)
    major = long.groupBy("doc_id").agg(F.max(F.struct("g", (-F.col("topic")).alias("t")))["t"].alias("t")).select("doc_id", (-F.col("t")).alias("topic")).join(h, "doc_id").groupBy("topic").agg(F.count("*").alias("dominant"), F.avg("entropy").alias("entropy"))
    return long.groupBy("topic").agg(F.avg("g").alias("mean")).join(major, "topic", "left").select("topic", F.coalesce("dominant", F.lit(0)).alias("dominant"), F.round("mean", 6).alias("mean"), F.round("entropy", 6).alias("entropy"))


@query()
def yearly_presence(spark: SparkSession, d: str) -> DataFrame:
    _, _, gamma = M.lda(_documents(spark, d), "doc_id", "terms", 4, passes=30)
    y = table(spark, d, "corpus_propre").select("doc_id", F.col("year").try_cast("int").alias("year"))
    return M.yearly_presence(gamma.join(y, "doc_id").where("year IS NOT NULL"), "year").withColumn("mean", F.round("mean", 6))


@query()
def jenks_periods(spark: SparkSession, d: str) -> DataFrame:
    y = toks(spark, d).withColumn("y", F.col("year").try_cast("int")).where("y IS NOT NULL").groupBy("y").agg(F.count("*").alias("n"))
    return M.jenks_periods(y, "y", "n")


@query()
def pelt_breaks(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "events").groupBy("event_type", F.dayofmonth("ts").alias("day")).agg(F.avg("value").alias("v"))
    return M.breaks(o, "event_type", "day", "v", penalty=3.0)


@query()
def ward_clusters(spark: SparkSession, d: str) -> DataFrame:
    m = S.mean_vectors(table(spark, d, "embeddings"), "label", "embedding").groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "mean"))), lambda s: s["mean"]).alias("v"))
    return M.ward(m, "label", "v", 4)


@query()
def reduced_embeddings(spark: SparkSession, d: str) -> DataFrame:
    return M.reduce_dimensions(table(spark, d, "embeddings"), "vec_id", "embedding").select("vec_id", F.transform("reduced", lambda x: F.round(F.abs(x), 4)).alias("reduced"))
