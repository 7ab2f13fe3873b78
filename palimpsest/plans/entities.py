"""Cleaning, entity resolution and record linkage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.similarity import indel_ratio_udf
from ..operators import resolve as R
from ..operators import tabular as O
from ..session import cut, table
from .registry import Registry

query = Registry()
QUERIES, SQL = query.queries, query.sql

# In DuckDB's patterns \w is ASCII only.
_KEY = r"trim(regexp_replace(regexp_replace(strip_accents(lower({c})), '[^\p{{L}}\p{{N}}_\p{{M}}\s]', ' ', 'g'), '[\s\x{{00a0}}]+', ' ', 'g'))"


def key_sql(c: str) -> str:
    return _KEY.format(c=c)


@query(f"SELECT key, count(*) AS members, min(id) AS keep FROM (SELECT id, {key_sql('NomComplet')} AS key FROM authors WHERE NomComplet IS NOT NULL) WHERE key <> '' GROUP BY 1 HAVING count(*) > 1")
def exact_normalized_dups(spark: SparkSession, d: str) -> DataFrame:
    return R.exact_groups(table(spark, d, "authors").withColumn("key", T.name_key(F.col("NomComplet"))), "key")


_INFO = " + ".join(f"(coalesce(trim({c}::varchar), '') <> '')::int" for c in ("title", "secondary_title", "year", "issn", "volume", "number", "publisher", "abstract"))


@query(f"""WITH r AS (SELECT *, regexp_replace(lower(trim(doi)), '^(https?://(dx\\.)?doi\\.org/|doi:)\\s*', '') AS k, {_INFO} AS score FROM reference),
v AS (SELECT * FROM r WHERE starts_with(k, '10.')), g AS (SELECT k, coalesce(max(year) - min(year), 0) AS spread FROM v GROUP BY 1 HAVING count(*) > 1),
p AS (SELECT v.*, CASE WHEN spread > 1 THEN year END AS part FROM v JOIN g USING (k))
SELECT k AS doi, part, arg_min(id, (-score, id)) AS survivor, count(*) AS members, min(year) AS first_year, max(dispo_JSTOR) AS available FROM p GROUP BY 1, 2""")
def doi_style_group_resolve(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "reference").withColumn("k", T.doi_key(F.col("doi"))).where(F.col("k").startswith("10.")).drop("doi").withColumnRenamed("k", "doi")
    g = R.doi_groups(r, "doi", "year", ["title", "secondary_title", "year", "issn", "volume", "number", "publisher", "abstract"], ["dispo_JSTOR"])
    return g.withColumnRenamed("dispo_JSTOR", "available")


@query(r"""WITH k AS (SELECT id, upper(regexp_replace(regexp_split_to_array(issn, '[;,]')[1], '[^0-9Xx]', '', 'g')) AS k FROM reference WHERE issn IS NOT NULL)
SELECT k AS key, count(*) AS members, min(id) AS keep FROM k WHERE length(k) >= 7 GROUP BY 1 HAVING count(*) > 1""")
def issn_groups(spark: SparkSession, d: str) -> DataFrame:
    return R.exact_groups(table(spark, d, "reference").where("issn IS NOT NULL").withColumn("key", T.issn_key(F.col("issn"))), "key")


@query(f"""WITH RECURSIVE n AS (SELECT id, list_sort(string_split({key_sql('NomComplet')}, ' ')) AS w FROM authors WHERE NomComplet IS NOT NULL),
s AS (SELECT id, array_to_string(list_filter(w, lambda x: length(x) > 1), ' ') AS m, array_to_string(w, ' ') AS f FROM n),
p AS (SELECT a.id AS a, b.id AS b FROM s a JOIN s b ON a.m = b.m AND a.id < b.id AND length(a.m) >= 4 AND a.f <> '' AND b.f <> '' AND 1 - levenshtein(a.f, b.f)::double / greatest(length(a.f), length(b.f)) >= 0.85)
SELECT a, b FROM p""".replace("WITH RECURSIVE", "WITH"))
def token_signature_pairs(spark: SparkSession, d: str) -> DataFrame:
    k = T.name_key(F.col("NomComplet"))
    s = table(spark, d, "authors").select("id", k.alias("k")).select("id", T.minimal_signature(F.col("k")).alias("minimal"), T.full_signature(F.col("k")).alias("full"))
    p = O.block_pairs(s.where(F.length("minimal") >= 4), "id", "minimal", "full")
    return p.where(R.native_ratio(F.col("x_full"), F.col("y_full")) >= 0.85).select("a", "b")


@query()
def token_signature_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Names in another order, by the indel ratio; tested against a slow version."""
    k = T.name_key(F.col("NomComplet"))
    s = table(spark, d, "authors").where("NomComplet IS NOT NULL").select("id", k.alias("k")).select("id", T.minimal_signature(F.col("k")).alias("minimal"), T.full_signature(F.col("k")).alias("full"))
    return R.suggestions(R.signature_clusters(s))


_PARTS = f"SELECT id, {key_sql('Nom')} AS f, {key_sql('Prenom')} AS g FROM authors WHERE Nom IS NOT NULL AND Prenom IS NOT NULL"


@query(f"""WITH n AS ({_PARTS}) SELECT a.id AS a, b.id AS b FROM n a JOIN n b ON a.f = b.f AND a.id < b.id AND a.f <> '' AND a.g <> '' AND b.g <> ''
WHERE (length(a.g) < 3 AND starts_with(b.g, a.g)) OR (length(b.g) < 3 AND starts_with(a.g, b.g))""")
def initials_match(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "authors").where("Nom IS NOT NULL AND Prenom IS NOT NULL").select("id", T.name_key(F.col("Nom")).alias("family"), T.name_key(F.col("Prenom")).alias("given"))
    p = O.block_pairs(n.where("family <> '' AND given <> ''"), "id", "family", "given")
    return p.where(T.initial_match(F.col("x_given"), F.col("y_given"))).select("a", "b")


@query()
def initial_clusters(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "authors").where("Nom IS NOT NULL AND Prenom IS NOT NULL").select("id", T.name_key(F.col("Nom")).alias("family"), T.name_key(F.col("Prenom")).alias("given"))
    return R.suggestions(R.initial_clusters(n, T.initial_match))


@query()
def transliterate_match(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "authors").where("NomComplet IS NOT NULL")
    return R.suggestions(R.transliterated_clusters(a.select("id", T.name_key(T.to_latin(F.col("NomComplet"))).alias("latin"), T.script(F.col("NomComplet")).alias("script"))))


_RAW_IDS = """WITH RECURSIVE v AS (SELECT id, 'isni' AS field, isni AS value FROM authors UNION ALL SELECT id, 'orcid', CASE WHEN regexp_matches(orcid, '^0000-2[0-9]{3}-[0-9]{4}-[0-9X]{4}$') THEN orcid END FROM authors
UNION ALL SELECT id, 'viaf', CASE WHEN regexp_matches(PPN_VIAF, '^[1-9][0-9]+$') THEN PPN_VIAF END FROM authors),
links AS (SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON a.field = b.field AND a.value = b.value AND a.id <> b.id WHERE trim(a.value) <> ''),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b), g AS (SELECT a AS id, min(least(a, b)) AS component FROM reach GROUP BY 1)
"""


def _raw_identifiers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "authors").select("id", "isni", F.when(F.col("orcid").rlike("^0000-2[0-9]{3}-[0-9]{4}-[0-9X]{4}$"), F.col("orcid")).alias("orcid"), F.when(F.col("PPN_VIAF").rlike("^[1-9][0-9]+$"), F.col("PPN_VIAF")).alias("viaf"))


@query(_RAW_IDS + "SELECT id, component FROM g")
def shared_identifier_components(spark: SparkSession, d: str) -> DataFrame:
    return R.shared_identifier_clusters(_raw_identifiers(spark, d), ["isni", "orcid", "viaf"])


@query(_RAW_IDS + """SELECT component, count(DISTINCT CASE WHEN regexp_matches(orcid, '^0000-2[0-9]{3}-[0-9]{4}-[0-9X]{4}$') THEN orcid END) > 1 AS orcid_conflict,
arg_min(a.Nom, id) FILTER (WHERE coalesce(trim(a.Nom), '') <> '') AS family, arg_min(id, (-coalesce(n, 0), id)) AS survivor FROM g JOIN authors a USING (id) LEFT JOIN (SELECT author_id, count(*) AS n FROM ecriture GROUP BY 1) e ON author_id = id GROUP BY 1""")
def resolve_identifier_groups(spark: SparkSession, d: str) -> DataFrame:
    g = R.shared_identifier_clusters(_raw_identifiers(spark, d), ["isni", "orcid", "viaf"])
    n = table(spark, d, "ecriture").groupBy(F.col("author_id").alias("id")).agg(F.count("*").alias("n"))
    m = cut(g.join(table(spark, d, "authors").select("id", "Nom"), "id").join(_raw_identifiers(spark, d), "id").join(n, "id", "left"))
    bad = R.conflicts(m, "component", ["orcid"]).select("component", F.lit(True).alias("bad"))
    best = R.elect(m, "component", [-F.coalesce("n", F.lit(0)), F.col("id")])
    return best.join(R.merge_fields(m, "component", ["Nom"]), "component").join(bad, "component", "left").select("component", F.coalesce("bad", F.lit(False)).alias("orcid_conflict"), F.col("Nom").alias("family"), "survivor")


@query("""WITH m AS (SELECT s.record_id AS gone, min(remplace_par) AS keep FROM suppressions s WHERE lower(trim(table_cible)) = 'authors' AND remplace_par IS NOT NULL GROUP BY 1)
SELECT DISTINCT reference_id, coalesce(keep, author_id) AS author_id FROM ecriture LEFT JOIN m ON gone = author_id""")
def apply_decisions_relink(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "suppressions").where(F.lower(F.trim("table_cible")) == "authors").where("remplace_par IS NOT NULL")
    m = s.groupBy(F.col("record_id").alias("deleted")).agg(F.min("remplace_par").alias("keep"))
    return R.relink(table(spark, d, "ecriture"), "reference_id", "author_id", m)


@query("""WITH x AS (SELECT l_orderkey AS g, l_linenumber AS m, CASE WHEN l_linenumber = 1 THEN 'keep' WHEN l_returnflag = 'R' AND l_linenumber = 7 THEN 'skip' ELSE 'delete' END AS a FROM lineitem),
v AS (SELECT g, min(m) FILTER (WHERE a = 'keep') AS keep FROM x GROUP BY 1 HAVING count(*) FILTER (WHERE a = 'keep') = 1 AND count(*) FILTER (WHERE a = 'skip') = 0 AND count(*) FILTER (WHERE a = 'delete') > 0)
SELECT g AS group_id, keep, m AS deleted FROM x JOIN v USING (g) WHERE a = 'delete'""")
def validate_decisions(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("l_linenumber")
    x = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("group_id"), n.alias("member"), F.when(n == 1, "keep").when((F.col("l_returnflag") == "R") & (n == 7), "skip").otherwise("delete").alias("action"))
    return R.valid_decisions(x)


@query()
def greedy_leader_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Hosts of one year, led by the first that is alike."""
    r = table(spark, d, "reference").withColumn("k", T.accented_key(F.col("secondary_title")))
    return R.greedy_leaders(r, "year", "k", 0.85)


def _host_clusters(spark: SparkSession, d: str, threshold: float, with_authors: bool) -> DataFrame:
    r = table(spark, d, "reference").select("id", "year", T.reference_key(F.col("title")).alias("title"), T.reference_key(F.col("secondary_title")).alias("host"))
    lead = R.greedy_leaders(r, "year", "host", 0.85)
    a = None
    if with_authors:
        n = table(spark, d, "authors").select(F.col("id").alias("author_id"), T.reference_key(F.col("NomComplet")).alias("name"))
        a = table(spark, d, "ecriture").select(F.col("reference_id").alias("id"), "author_id").join(n, "author_id").select("id", "name")
    return R.suggestions(R.titled_clusters(r.join(lead, "id"), threshold, ["year", "leader"], a))


@query()
def reference_clusters(spark: SparkSession, d: str) -> DataFrame:
    return _host_clusters(spark, d, 0.88, True)


@query()
def reference_clusters_without_authors(spark: SparkSession, d: str) -> DataFrame:
    return _host_clusters(spark, d, 0.88, False)


@query()
def chapter_clusters(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "reference").where(O.filled(F.col("secondary_title")) & ~F.col("secondary_title").rlike("(?i)annal|speculum|object|bridgeman|american historical") & ~F.col("title").rlike("(?i)intro|preface|prologue|epilogue|abbrevia|conclu|index|appendix|rezension|review|droit"))
    r = r.select("id", T.ascii_key(F.col("title")).alias("k"), T.ascii_key(F.col("secondary_title")).alias("host"))
    r = r.withColumn("number", T.chapter_number(F.col("k"))).withColumn("title", T.without_chapter(F.col("k")))
    return R.suggestions(R.titled_clusters(r.join(R.greedy_leaders(r, None, "host", 0.8), "id"), 0.9, ["leader", "number"]))


_NR = "1 - levenshtein({a}, {b})::double / greatest(length({a}), length({b}))"


# DuckDB's levenshtein counts bytes, so that both sides compare ASCII keys
_ASCII = r"trim(regexp_replace(regexp_replace(regexp_replace(strip_accents(lower({c})), '[^\x00-\x7F]', '', 'g'), '[^a-z0-9_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


@query(rf"""WITH r AS (SELECT id, year, {_ASCII.format(c='title')} AS t, coalesce({_ASCII.format(c='secondary_title')}, '') AS h FROM reference WHERE title IS NOT NULL),
m AS (SELECT * FROM r WHERE year IS NOT NULL AND h <> ''), c AS (SELECT * FROM r WHERE year IS NULL OR h = ''),
p AS (SELECT a.id AS a, b.id AS b FROM m a JOIN m b ON a.id < b.id AND abs(a.year - b.year) <= 1 WHERE NOT ({_NR.format(a='a.h', b='b.h')} < 0.2 AND NOT contains(a.h, b.h) AND NOT contains(b.h, a.h)) AND a.t <> '' AND b.t <> '' AND
 ({_NR.format(a='a.t', b='b.t')} >= 0.85 OR (least(length(a.t), length(b.t)) >= 10 AND (contains(a.t, b.t) OR contains(b.t, a.t))))
 UNION ALL SELECT least(a.id, b.id), greatest(a.id, b.id) FROM c a JOIN r b ON a.id <> b.id WHERE a.t <> '' AND b.t <> '' AND list_has_any(string_split(a.t, ' '), string_split(b.t, ' ')) AND
 ({_NR.format(a='a.t', b='b.t')} >= 0.85 OR (least(length(a.t), length(b.t)) >= 10 AND (contains(a.t, b.t) OR contains(b.t, a.t)))))
SELECT DISTINCT a, b FROM p""")
def containment_catch_all(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "reference").where("title IS NOT NULL").select("id", "year", T.ascii_key(F.col("title")).alias("title"), F.coalesce(T.ascii_key(F.col("secondary_title")), F.lit("")).alias("host"))
    return R.permissive_pairs(r.where("title <> ''"))


@query()
def aggressive_dedup(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "reference").select("id", "year", T.aggressive_key(F.col("title")).alias("title"), T.aggressive_key(F.col("secondary_title")).alias("host"))
    return R.aggressive(r)


@query("""WITH h AS (SELECT year AS y, count(*) AS n FROM reference WHERE year IS NOT NULL GROUP BY 1), m AS (SELECT year AS y, count(DISTINCT lower(trim(title))) AS n FROM reference WHERE year IS NOT NULL GROUP BY 1),
l AS (SELECT year AS y, count(DISTINCT left(lower(trim(title)), 12)) + (year % 9 = 0)::int * 50 AS n FROM reference WHERE year IS NOT NULL GROUP BY year)
SELECT y, coalesce(l.n, 0) AS low, coalesce(m.n, 0) AS mid, coalesce(h.n, 0) AS high FROM l FULL JOIN m USING (y) FULL JOIN h USING (y) WHERE l.n > m.n OR m.n > h.n""")
def envelope_violations(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "reference").where("year IS NOT NULL").withColumn("t", F.lower(F.trim("title"))).withColumnRenamed("year", "y")
    high, mid = r.groupBy("y").agg(F.count("*").alias("n")), r.groupBy("y").agg(F.count_distinct("t").alias("n"))
    low = r.groupBy("y").agg(F.count_distinct(F.substring("t", 1, 12)).alias("n")).withColumn("n", F.col("n") + (F.col("y") % 9 == 0).cast("int") * 50)
    return R.outside_envelope(low, mid, high, "y")


@query(r"""WITH s AS (SELECT id, 'doi' AS kind, regexp_replace(lower(trim(doi)), '^(https?://(dx\.)?doi\.org/|doi:)\s*', '') AS value FROM reference UNION ALL SELECT id, 'issn', CASE WHEN length(upper(regexp_replace(regexp_split_to_array(issn, '[;,]')[1], '[^0-9Xx]', '', 'g'))) < 7 THEN '' ELSE upper(regexp_replace(regexp_split_to_array(issn, '[;,]')[1], '[^0-9Xx]', '', 'g')) END FROM reference
UNION ALL SELECT id, 'page', trim(regexp_split_to_array(start_page, '[-–]')[1]) FROM reference UNION ALL SELECT id, 'title', regexp_replace(trim(regexp_replace(title, '[\s]+', ' ', 'g')), '\s+', ' ', 'g') FROM reference)
SELECT id, kind, value FROM s WHERE value IS NOT NULL""".replace("regexp_replace(trim(regexp_replace(title, '[\\s]+', ' ', 'g')), '\\s+', ' ', 'g')", "lower(trim(regexp_replace(title, '[\\s\\x{00a0}\\x{2000}-\\x{200a}\\x{202f}]+', ' ', 'g')))"))
def scalar_clean_suite(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "reference")
    kinds = {"doi": T.doi_key(F.col("doi")), "issn": T.issn_key(F.col("issn")), "page": T.first_page(F.col("start_page")), "title": T.folded(F.col("title"))}
    return r.select("id", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in kinds.items()])).alias("s")).select("id", "s.kind", "s.value").where("value IS NOT NULL")


@query(r"""SELECT id, CASE WHEN starts_with(b, '[') THEN trim(regexp_replace(regexp_replace(b, '^\[\s*', ''), '^([^\]]*)\]', '\1')) ELSE b END AS title FROM (SELECT id, trim(regexp_replace(trim(regexp_replace(trim(coalesce(title, '')), '^\.(\s+|(\p{L}))', '\2')), '^:', '')) AS b FROM reference)""")
def title_artefacts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "reference").select("id", T.clean_title(F.col("title")).alias("title"))


@query()
def normalizer_suite(spark: SparkSession, d: str) -> DataFrame:
    """All normalisers side by side, marks of all scripts included; tested against slow versions."""
    t = F.col("title")
    return table(spark, d, "reference").select("id", T.name_key(t).alias("name_key"), T.reference_key(t).alias("reference_key"), T.ascii_key(t).alias("ascii_key"), T.strict_ascii_key(t).alias("strict_key"), T.accented_key(t).alias("accented_key"),
        T.aggressive_key(t).alias("aggressive_key"), T.clean_markup(t).alias("markup"), T.context_key(t).alias("context_key"), T.folded(t).alias("folded"), T.one_line(t).alias("one_line"), T.entities(t, True).alias("entities"))


@query(r"""SELECT id, trim(regexp_replace(regexp_replace(lower(title), '[^\p{L}\p{N}_\p{M}\s\x{00a0}]', ' ', 'g'), '[\s\x{00a0}]+', ' ', 'g')) AS accented_key, lower(translate(title, '–—‒‑’‘', '----''''')) AS context_key,
trim(regexp_replace(coalesce(title, ''), '[\r\n\t]+', ' ', 'g')) AS one_line, strip_accents(lower(title)) AS plain FROM reference WHERE title IS NOT NULL""")
def native_normalizers(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("title")
    return table(spark, d, "reference").where("title IS NOT NULL").select("id", T.accented_key(t).alias("accented_key"), T.context_key(t).alias("context_key"), T.one_line(t).alias("one_line"), T.strip_marks(F.lower(t)).alias("plain"))


@query(r"""WITH t AS (SELECT id, upper(trim(regexp_replace(regexp_replace(lower(title), '[^a-z0-9_\s]', ' ', 'g'), '\s+', ' ', 'g'))) AS s FROM reference WHERE regexp_matches(title, '^[\x20-\x7E]+$')),
n AS (SELECT id, s, try_cast(nullif(regexp_extract(s, '(?:CHAPITRE|CHAPTER|PART|PARTIE|TEIL|CAPITULO|TOME|VOLUME)\s*(\d+)', 1), '') AS int) AS a, try_cast(nullif(regexp_extract(s, '[\s(](\d+)[\s.:)]', 1), '') AS int) AS b FROM t)
SELECT id, CASE WHEN a BETWEEN 1 AND 25 THEN a WHEN b BETWEEN 1 AND 25 AND a IS NULL THEN b END AS number FROM n WHERE regexp_matches(s, '(CHAPITRE|CHAPTER|PART|PARTIE|TEIL|CAPITULO|TOME|VOLUME)\s*\d+')""")
def chapter_number(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "reference").where(F.col("title").rlike(r"^[\x20-\x7E]+$")).withColumn("k", T.ascii_key(F.col("title")))
    return r.where(F.upper("k").rlike(r"(CHAPITRE|CHAPTER|PART|PARTIE|TEIL|CAPITULO|TOME|VOLUME)\s*\d+")).select("id", T.chapter_number(F.col("k")).alias("number"))


@query(r"""SELECT id, CASE WHEN contains(t, ',') THEN len(list_filter(string_split_regex(regexp_replace(t, '^[^,]*,', ''), '[\s,]+'), lambda w: w <> '' AND NOT regexp_matches(regexp_replace(w, '\.+$', ''), '^\p{L}{1,2}$'))) >= 1
ELSE len(list_filter(string_split_regex(t, '[\s,]+'), lambda w: w <> '' AND NOT regexp_matches(regexp_replace(w, '\.+$', ''), '^\p{L}{1,2}$'))) >= 2 END AS usable,
coalesce(nullif(trim(NomComplet), ''), CASE WHEN nullif(trim(Nom), '') IS NOT NULL AND nullif(trim(Prenom), '') IS NOT NULL THEN trim(Nom) || ', ' || trim(Prenom) END, nullif(trim(Nom), '')) AS name,
left(replace(NomComplet, ' ', '_'), 50) AS variable FROM (SELECT *, trim(coalesce(NomComplet, '')) AS t FROM authors)""")
def name_builder(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "authors")
    return a.select("id", T.usable_name(F.col("NomComplet")).alias("usable"), T.full_name(F.col("NomComplet"), F.col("Nom"), F.col("Prenom")).alias("name"), T.variable(F.col("NomComplet")).alias("variable"))


@query(r"""SELECT id, CASE WHEN len(regexp_extract_all(n, '[\x{0400}-\x{04FF}]')) > len(regexp_extract_all(n, '[\x{0370}-\x{03FF}]')) THEN 'ru' WHEN len(regexp_extract_all(n, '[\x{0370}-\x{03FF}]')) > 0 THEN 'el' END AS script FROM (SELECT id, NomComplet AS n FROM authors) WHERE n IS NOT NULL""")
def script_of_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "authors").where("NomComplet IS NOT NULL").select("id", T.script(F.col("NomComplet")).alias("script"))


@query()
def transliteration(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "authors").select("id", T.to_latin(F.col("NomComplet")).alias("latin"), T.name_parts(F.col("NomComplet")).alias("parts"), T.author_name(F.col("NomComplet")).alias("clean"))


_PAGE = "'<html lang=\"' || coalesce(lang, '') || '\"><head>' || CASE WHEN doc_id % 3 = 0 THEN '<meta name=\"DC.language\" content=\"' || coalesce(source, '') || '\">' ELSE '' END || '</head><p>' || coalesce(title, '') || '</p></html>'"


@query(f"""SELECT doc_id, coalesce(nullif(regexp_extract(page, '(?i)<meta[^>]*name="(?:DC.language)"[^>]*content="([^"]+)"', 1), ''), nullif(regexp_extract(page, '(?i)<html[^>]*lang="([^"]+)"', 1), '')) AS language,
trim(regexp_replace(regexp_replace(page, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS plain FROM (SELECT doc_id, {_PAGE.replace('title', 'collection_id')} AS page FROM documents)""")
def html_lang_priority(spark: SparkSession, d: str) -> DataFrame:
    e = lambda c: F.coalesce(c, F.lit(""))
    meta = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('<meta name="DC.language" content="'), e("source"), F.lit('">'))).otherwise("")
    page = F.concat(F.lit('<html lang="'), e("lang"), F.lit('"><head>'), meta, F.lit("</head><p>"), e("collection_id"), F.lit("</p></html>"))
    return table(spark, d, "documents").select("doc_id", page.alias("page")).select("doc_id", T.html_language(F.col("page")).alias("language"), T.html_text(F.col("page")).alias("plain"))


@query(r"""SELECT doc_id, nullif(regexp_extract(text, '(10\.\d{4,}/[\w.();:/\-]+)', 1), '') AS doi FROM documents WHERE text IS NOT NULL""")
def extract_identifiers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", T.extract_doi(F.col("text")).alias("doi"))


@query()
def similarity_suite(spark: SparkSession, d: str) -> DataFrame:
    """Scores of pairs of like titles by indel ratio; tested in pytest."""
    r = table(spark, d, "reference").where("title IS NOT NULL").select("id", T.reference_key(F.col("title")).alias("t"), T.reference_key(F.col("secondary_title")).alias("h"), "year")
    p = O.block_pairs(r.withColumn("block", F.substring("t", 1, 8)), "id", "block", "t", "h", "year")
    s = R.similar_pairs(p, "x_t", "y_t", 0.7)
    ratio = indel_ratio_udf()
    host = F.when((F.coalesce("x_h", F.lit("")) != "") & (F.coalesce("y_h", F.lit("")) != ""), ratio(F.coalesce("x_h", F.lit("")), F.coalesce("y_h", F.lit(""))))
    s = s.withColumn("host", host)
    return s.select("a", "b", F.round("score", 6).alias("ratio"), F.round(R.containment_bonus(F.col("x_t"), F.col("y_t"), F.col("score")), 6).alias("bonus"), F.round(R.contained_ratio(F.col("x_t"), F.col("y_t"), F.col("score")), 6).alias("contained"),
        F.round(R.combined_score(F.col("score"), F.col("host"), F.col("x_t").isin(*T.GENERIC_TITLES)), 6).alias("combined"), F.round(R.config_score(F.col("score"), F.col("host")), 6).alias("configuration"), F.round(R.authority_score(F.col("score"), F.coalesce("host", F.lit(0.0))), 6).alias("authority"))


@query("""WITH s1 AS (SELECT r.id, i.item_id AS m, 1.0::double AS score FROM reference r JOIN jstor_meta i ON lower(trim(r.title)) = lower(trim(i.title)) AND r.secondary_title = i.is_part_of),
s2 AS (SELECT r.id, i.item_id AS m, 0.9::double AS score FROM reference r JOIN jstor_meta i ON lower(trim(r.title)) = lower(trim(i.title)) AND r.year = try_cast(left(published_date, 4) AS int)),
u AS (SELECT *, 1 AS stage FROM s1 UNION ALL SELECT *, 2 FROM s2), b AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY id ORDER BY stage, score DESC, m) = 1)
SELECT r.id, stage, m AS match, score FROM reference r LEFT JOIN b USING (id)""")
def linkage_cascade(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "reference").select("id", F.lower(F.trim("title")).alias("t"), "secondary_title", "year")
    i = table(spark, d, "jstor_meta").select(F.col("item_id").alias("match"), F.lower(F.trim("title")).alias("t"), F.col("is_part_of").alias("secondary_title"), F.substring("published_date", 1, 4).try_cast("int").alias("year"))
    s1 = r.join(i.drop("year"), ["t", "secondary_title"]).select("id", "match", F.lit(1.0).alias("score"))
    s2 = r.join(i.drop("secondary_title"), ["t", "year"]).select("id", "match", F.lit(0.9).alias("score"))
    return R.cascade(r, [s1, s2], "id")


@query("""WITH a AS (SELECT doc_id, lower(left(lang, 2)) AS label FROM documents WHERE lang IS NOT NULL), b AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'fr' ELSE lower(left(lang, 2)) END AS label FROM documents WHERE lang IS NOT NULL), m AS (SELECT doc_id, 'xx' AS label FROM documents WHERE doc_id % 35 = 0)
SELECT doc_id, coalesce(m.label, CASE WHEN a.label = b.label THEN a.label END) AS label, CASE WHEN m.label IS NOT NULL THEN 'manual' WHEN a.label = b.label THEN 'agreed' ELSE 'conflict' END AS source FROM a JOIN b USING (doc_id) LEFT JOIN m USING (doc_id)""")
def two_raters(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").where("lang IS NOT NULL").select("doc_id", F.lower(F.substring("lang", 1, 2)).alias("label"))
    y = x.withColumn("label", F.when(F.col("doc_id") % 5 == 0, "fr").otherwise(F.col("label")))
    return R.two_raters(x, y, "doc_id", table(spark, d, "documents").where("doc_id % 35 = 0").select("doc_id", F.lit("xx").alias("label")))


@query("""WITH n AS (SELECT DISTINCT trim(s) AS name FROM (SELECT unnest(string_split(creators_string, ';')) AS s FROM jstor_meta) WHERE trim(s) <> ''), k AS (SELECT NomComplet AS name, min(id) AS id FROM authors GROUP BY 1)
SELECT name, coalesce(id, (SELECT max(id) FROM k) + row_number() OVER (PARTITION BY id IS NULL ORDER BY name)) AS id FROM n LEFT JOIN k USING (name)""")
def find_or_create(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "jstor_meta").select(F.explode(F.split("creators_string", ";")).alias("s")).select(F.trim("s").alias("name"))
    return R.find_or_create(n, table(spark, d, "authors").groupBy(F.col("NomComplet").alias("name")).agg(F.min("id").alias("id")))


@query("""SELECT id, CASE WHEN k = 'JSON' THEN 'x' END AS nothing, coalesce(nullif(trim(volume), ''), '0') AS volume, coalesce(volume, '') <> coalesce(nullif(trim(volume), ''), '0') AS differs FROM (SELECT *, 'x' AS k FROM reference)""")
def fill_only_changed(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "reference").withColumn("volume", F.coalesce("volume", F.lit("")))
    c = O.changed(r, {"volume": O.fill_if_empty(F.col("volume"), F.lit("0"))})
    return c.select("id", F.lit(None).cast("string").alias("nothing"), "volume", (F.size("changed") > 0).alias("differs"))


@query("""SELECT CAST(json_extract_string(j, '$.published.y') AS int) AS year, string_split(json_extract_string(j, '$.page'), '-')[1] AS page, json_extract_string(j, '$.issn[0]') AS issn, count(*) AS n
FROM (SELECT '{"page": "' || l_linenumber || '-9", "issn": ["' || l_returnflag || '", "z"], "published": {"y": ' || year(l_shipdate) || '}}' AS j FROM lineitem) GROUP BY 1, 2, 3""")
def crossref_fields_fill(spark: SparkSession, d: str) -> DataFrame:
    j = F.concat(F.lit('{"page": "'), F.col("l_linenumber"), F.lit('-9", "issn": ["'), F.col("l_returnflag"), F.lit('", "z"], "published": {"y": '), F.year("l_shipdate"), F.lit("}}"))
    x = F.from_json(j, "page string, issn array<string>, published struct<y: int>, issued struct<y: int>")
    l = table(spark, d, "lineitem").select(x.alias("x"))
    return l.groupBy(F.coalesce("x.published.y", "x.issued.y").alias("year"), T.first_page(F.col("x.page")).alias("page"), F.get("x.issn", F.lit(0)).alias("issn")).agg(F.count("*").alias("n"))
