"""Lexicometry over annotated tokens: one row per token, long counts, pivots only at the sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .tabular import frequency_bucket


def tokens(corpus: DataFrame, features: str = "lexical_features", doc: str = "doc_id", *keep: str) -> DataFrame:
    """(doc, keep, pos_in_doc, token, lemma, pos) of an annotated corpus; documents without features give no rows."""
    return corpus.select(doc, *keep, F.posexplode(features).alias("at", "f")).select(doc, *keep, "at", "f.token", "f.lemma", "f.pos")


def words(df: DataFrame, key: str, text: str, *keep: str) -> DataFrame:
    """(key, keep, at, token): lower-case words of a text."""
    return df.select(key, *keep, F.posexplode(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))).alias("at", "token"))


def content(df: DataFrame, term: str = "lemma", stop: tuple[str, ...] = (), drop: tuple[str, ...] = ("PUNCT", "NUM", "SPACE", "SYM", "X"), least: int = 3) -> DataFrame:
    """Rows whose term is alphabetic, long enough and no stop word, and whose part of speech counts."""
    d = df.where(F.col(term).rlike(r"^\p{L}+$") & (F.length(term) >= least))
    if "pos" in df.columns:
        d = d.where(~F.coalesce("pos", F.lit("")).isin(*drop))
    return d.where(~F.lower(term).isin(*stop)) if stop else d


def frequencies(df: DataFrame, term: str, *group: str) -> DataFrame:
    return df.groupBy(*group, term).agg(F.count("*").alias("n"))


def group_sizes(counts: DataFrame, group: str, term: str = "token") -> DataFrame:
    """(group, total, types, hapax, richness) from long counts."""
    return counts.groupBy(group).agg(F.sum("n").alias("total"), F.count(term).alias("types"), F.sum((F.col("n") == 1).cast("int")).alias("hapax"), (100.0 * F.count(term) / F.sum("n")).alias("richness"))


def zipf(counts: DataFrame, term: str = "token", top: int = 1000) -> DataFrame:
    """(term, n, rank, predicted, difference, percent) of the most frequent terms, against C / rank."""
    t = counts.orderBy(F.desc("n"), term).limit(top).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), term)))
    first = F.max("n").over(Window.partitionBy())
    t = t.withColumn("predicted", first / F.col("rank"))
    return t.withColumn("difference", F.col("n") - F.col("predicted")).withColumn("percent", 100 * F.col("n") / F.col("predicted"))


def contingency(counts: DataFrame, term: str, group: str, least: int = 2, top: int = 500) -> DataFrame:
    """(term, group, n, profile) of the most frequent terms; at most `top` terms are broadcast."""
    best = counts.groupBy(term).agg(F.sum("n").alias("total")).where(F.col("total") >= least).orderBy(F.desc("total"), term).limit(top)
    return counts.join(F.broadcast(best), term).select(term, group, "n", (F.col("n") / F.col("total")).alias("profile"))


def tfidf(counts: DataFrame, doc: str, term: str, least: int = 3) -> DataFrame:
    """(doc, term, tfidf): raw frequency times ln((1+N)/(1+df))+1, rows of length one. N counts the documents
    that have a term."""
    df = counts.groupBy(term).agg(F.count("*").alias("df")).where(F.col("df") >= least)
    n = counts.agg(F.count_distinct(doc).alias("docs"))
    w = counts.join(df, term).crossJoin(F.broadcast(n)).select(doc, term, (F.col("n") * (F.log((1 + F.col("docs")) / (1 + F.col("df"))) + 1)).alias("w"))  # one row is broadcast
    norm = w.groupBy(doc).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, doc).select(doc, term, (F.col("w") / F.col("norm")).alias("tfidf"))


def class_tfidf(counts: DataFrame, group: str, term: str, least: int = 1) -> DataFrame:
    """(group, term, score): term share of the class times ln(1 + A/f), A the mean size of a class, f the
    term's frequency."""
    size = counts.groupBy(group).agg(F.sum("n").alias("size"))
    f = counts.groupBy(term).agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    a = F.broadcast(size.agg(F.avg("size").alias("A")))  # one row
    return counts.join(size, group).join(f, term).crossJoin(a).select(group, term, (F.col("n") / F.col("size") * F.log(1 + F.col("A") / F.col("f"))).alias("score"))


def bigrams(df: DataFrame, doc: str, token: str = "token") -> DataFrame:
    """(doc, at, a, b): neighbouring tokens."""
    return df.select(doc, "at", F.col(token).alias("a"), F.lead(token).over(Window.partitionBy(doc).orderBy("at")).alias("b")).where("b IS NOT NULL")


def kwic(corpus: DataFrame, keyword: str, window: int = 8, doc: str = "doc_id", array: str = "tokens", *keep: str) -> DataFrame:
    """(doc, keep, at, left, keyword, right) around each place of a word. array: the tokens of a document;
    contexts are slices of it, so that nothing is shuffled."""
    key = T.context_key(F.lit(keyword))
    at = F.filter(F.sequence(F.lit(1), F.size(array)), lambda i: T.context_key(F.element_at(array, i)) == key)
    d = corpus.where(F.size(array) > 0).select(doc, *keep, array, F.explode(at).alias("at"))
    left = F.slice(array, F.greatest(F.lit(1), F.col("at") - window), F.least(F.lit(window), F.col("at") - 1))
    right = F.slice(array, F.col("at") + 1, F.lit(window))
    return d.select(doc, *keep, (F.col("at") - 1).alias("at"), F.array_join(left, " ").alias("left"), F.element_at(array, F.col("at")).alias("keyword"), F.array_join(right, " ").alias("right"))


def iramuteq(lines: DataFrame) -> Column:
    """A corpus entry: header with year and title, text, blank line. lines: year, title, text."""
    head = F.concat(F.lit("**** *YEAR_"), F.coalesce(F.col("year").cast("string"), F.lit("")), F.lit(" *DOC_"), T.variable(T.one_line(F.col("title"))))
    return F.concat_ws("\n", head, T.one_line(F.col("text")), F.lit(""))


def progression(df: DataFrame, group: str, doc: str, term: str, wanted: list[str]) -> DataFrame:
    """(group, term, n, total, docs, per_million): wanted terms by group, zeros included."""
    t = df.groupBy(group).agg(F.count("*").alias("total"))
    n = df.where(F.col(term).isin(*wanted)).groupBy(group, term).agg(F.count("*").alias("n"), F.count_distinct(doc).alias("docs"))
    grid = t.select(group, "total", F.explode(F.array(*[F.lit(w) for w in wanted])).alias(term))
    return grid.join(n, [group, term], "left").na.fill(0, ["n", "docs"]).withColumn("per_million", F.round(1e6 * F.col("n") / F.col("total"), 2))


def pmi(df: DataFrame, doc: str, least: int = 4, floor: float = 20.0, rare: float = 0.999) -> DataFrame:
    """(a, b, n, pmi): neighbours that stand together far more than alone, the rarer of common words left out."""
    uni = df.groupBy("token").agg(F.count("*").alias("n"))
    total = F.broadcast(uni.agg(F.sum("n").alias("whole"), F.percentile("n", F.lit(rare)).alias("cut")))  # one row
    bi = bigrams(df, doc).groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    d = bi.join(uni.select(F.col("token").alias("a"), F.col("n").alias("na")), "a").join(uni.select(F.col("token").alias("b"), F.col("n").alias("nb")), "b").crossJoin(total)
    d = d.where(F.least("na", "nb") <= F.col("cut"))
    return d.select("a", "b", "n", F.log2(F.col("n") * F.col("whole") / (F.col("na") * F.col("nb"))).alias("pmi")).where(F.col("pmi") >= floor)


def hyphen_candidates(df: DataFrame, doc: str) -> DataFrame:
    """(doc, at, t1, t2, merged): a token that ends with a hyphen and a word after it, genuine compounds left out."""
    b = bigrams(df, doc).where(T.broken(F.col("a")) & T.next_word(F.col("b")))
    b = b.where(~T.genuine_hyphen(T.stem(F.col("a")), F.col("b")))
    return b.select(doc, "at", F.col("a").alias("t1"), F.col("b").alias("t2"), F.concat(T.stem(F.col("a")), F.col("b")).alias("merged"))


def decide(candidates: DataFrame, places: DataFrame, pairs: DataFrame, doc: str) -> DataFrame:
    """candidates with `decision`: that of the place (doc, at, decision), else that of the pair (t1, t2,
    decision), else null."""
    d = candidates.join(places.select(doc, "at", F.col("decision").alias("_p")), [doc, "at"], "left").join(pairs.select("t1", "t2", F.col("decision").alias("_q")), ["t1", "t2"], "left")
    return d.withColumn("decision", F.coalesce("_p", "_q")).drop("_p", "_q")


def general_merges(decided: DataFrame) -> DataFrame:
    """(t1, t2, merged): the most frequent merge of each pair, ties by text; a capital inside a word is left out."""
    n = decided.groupBy("t1", "t2", "merged").agg(F.count("*").alias("n")).where(~F.col("merged").substr(F.lit(2), F.length("merged")).rlike(r"\p{Lu}"))
    best = n.groupBy("t1", "t2").agg(F.min(F.struct(-F.col("n"), F.col("merged"))).alias("b"))
    return best.select("t1", "t2", "b.merged")


def long_tokens(df: DataFrame, token: str = "token", fixed: int | None = 20, share: float = 0.999, floor: int = 15) -> DataFrame:
    """(token, n) of alphabetic tokens longer than a fixed length or a percentile of lengths."""
    d = df.where(F.col(token).rlike(r"^\p{L}+$"))
    if fixed is None:
        cut = F.broadcast(d.agg(F.greatest(F.lit(floor), F.percentile(F.length(token), F.lit(share))).alias("_cut")))  # one row
        d = d.crossJoin(cut).where(F.length(token) > F.col("_cut"))
    else:
        d = d.where(F.length(token) > fixed)
    return d.groupBy(token).agg(F.count("*").alias("n"))


def split_candidates(df: DataFrame, doc: str, dictionary: DataFrame, short: int = 2, longest: int = 15) -> DataFrame:
    """(doc, at, a, b, mode): A for a very short first part, B where the concatenation is a word and not both
    parts are. dictionary: word."""
    b = bigrams(df, doc).where(F.col("a").rlike(r"^\p{L}+$") & F.col("b").rlike(r"^\p{L}+$") & (F.col("a") != F.upper("a")) & (F.col("b") != F.upper("b")))
    mark = lambda w: dictionary.select(F.lower("word").alias(w)).distinct().withColumn(f"_{w}", F.lit(True))
    d = b.withColumns({"x": F.lower("a"), "y": F.lower("b"), "z": F.lower(F.concat("a", "b"))}).join(mark("x"), "x", "left").join(mark("y"), "y", "left").join(mark("z"), "z", "left")
    both = F.col("_x").isNotNull() & F.col("_y").isNotNull()
    mode = F.when(F.length("a") <= short, "A").when((F.length("a") <= longest) & ~both & F.col("_z").isNotNull(), "B")
    return d.select(doc, "at", "a", "b", mode.alias("mode")).where("mode IS NOT NULL")


def noise_scores(problems: DataFrame, df: DataFrame, doc: str, top: int = 30) -> DataFrame:
    """(doc, problems, tokens, score) of the noisiest documents."""
    t = df.groupBy(doc).agg(F.count("*").alias("tokens")).join(problems.groupBy(doc).agg(F.count("*").alias("problems")), doc)
    return t.withColumn("score", F.col("problems") / F.col("tokens")).orderBy(F.desc("score"), doc).limit(top)


def decision_statistics(decided: DataFrame) -> DataFrame:
    """(bucket, decision, pairs, places) of pairs by how often they occur."""
    n = decided.groupBy("t1", "t2", "decision").agg(F.count("*").alias("n"))
    return n.groupBy(frequency_bucket(F.col("n")).alias("bucket"), "decision").agg(F.count("*").alias("pairs"), F.sum("n").alias("places"))


def segment_counts(df: DataFrame, key: str, text: str, segments: DataFrame) -> DataFrame:
    """(key, category, n): how often segments of each category stand in a text. segments: segment, category -
    a fixed list, collected into the plan."""
    rows = segments.select(T.folded(F.col("segment")).alias("segment"), "category").distinct().orderBy("category", "segment").collect()  # a list of exclusions
    by: dict[str, list[str]] = {}
    for r in rows:
        by.setdefault(r.category, []).append(r.segment)
    counts = F.array(*[F.struct(F.lit(c).alias("category"), sum(((F.length(T.folded(F.col(text))) - F.length(F.replace(T.folded(F.col(text)), F.lit(s), F.lit("")))) / len(s) for s in segs), F.lit(0)).cast("bigint").alias("n")) for c, segs in by.items()])
    return df.select(key, F.explode(counts).alias("c")).select(key, "c.category", "c.n").where("n > 0")


def assign_topics(gamma: DataFrame, vector: str = "gamma", threshold: float = 0.15) -> DataFrame:
    """gamma with `major`, the first largest topic, and `topics`, all from the threshold on or else that one."""
    top = (F.array_position(vector, F.array_max(vector)) - 1).cast("int")
    over = F.filter(F.transform(vector, lambda x, i: F.when(x >= threshold, i)), lambda i: i.isNotNull())
    return gamma.withColumn("major", top).withColumn("topics", F.when(F.size(over) > 0, over).otherwise(F.array(top)))


def specific(matrix: DataFrame, word: str, threshold: float = 1.5, top: int = 20) -> DataFrame:
    """(word, score): the words most, and least, specific to one. matrix: i, j, score."""
    c = matrix.where(F.col("j") == word).select(F.col("i").alias("word"), "score")
    more = c.where(F.col("score") >= threshold).orderBy(F.desc("score"), "word").limit(top)
    return more.unionAll(c.where(F.col("score") <= -threshold).orderBy("score", "word").limit(top))
