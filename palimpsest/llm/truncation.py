"""Texts cut off by field limits (problem 10).

Two kinds of evidence meet in one mixture of whole and cut texts:

* censoring: for each source and unit (characters, bytes) a log-normal distribution of lengths is fitted
  by maximum likelihood, in which the texts that pile up at a candidate limit count as right-censored.
  At a limit the posterior of being censored is one less the share of texts that the fitted density
  expects at just that length. It is the prior of having been cut for the texts of that length;
* the ending: closed sentence, remark that is complete without a stop (keyword line, signature, shelf
  mark, identifier, page count, ornament), mark of omission, broken character or markup, open sentence; a
  text of a single open segment by its first words - how often closed sentences of the corpus begin with
  them, against how often such texts do.

How often cut and whole texts have an ending is learned from the corpus: EM over counts of (posterior,
ending), where texts at limits teach what cut ones look like and texts of the sources that truncate least
what whole ones look like; then each source's rate of breaks away from limits. A text's log-odds are those
of its ending plus those of its length: the same ending may be a case at its source's limit and none
elsewhere. A text that ends with a full sentence isn't a case by definition, cut or not.

Defined results: null, empty and blank texts are no cases and don't count in a source's texts; a null
source is a source of its own; repeated rows are judged alike; of a corpus without limits the endings and
the sources' rates decide. Whole texts are read; an ending is looked for in the last line (marks of omission and broken markup in
its last characters, more than any of them has), every length counts for itself.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, sieve, spread

# Words that introduce a line of keywords, in the languages of the corpus.
KEYWORD_LINES = ("keywords", "key words", "mots-clés", "mots clés", "schlagwörter", "schlüsselwörter", "stichwörter", "palabras clave", "parole chiave", "palavras-chave", "ключевые слова", "λέξεις-κλειδιά", "index terms")

CLOSED = r"[.!?؟。;][\s»”“\"'’)\]]*$"
ELLIPSIS = r"(\.\s?\.\s?\.|…|\[\s*(\.\.\.|…)\s*\]|\(\s*(\.\.\.|…)\s*\))$"
BROKEN_MARKUP = r"(\s*<[/!]?[a-zA-Z][^<>\n]{0,40}>?|\s*<[/!]?|\s*&#?[0-9A-Za-z]{0,8})$"
BOUNDARY = r"(?<=[.!?…»”\")\]])\s+(?=[\p{Lu}¿¡«„“\"'(\[])|[\r\n]+"
WORDS = 6  # of an opening, punctuation marks included

TAIL = 200  # characters; no mark of an ending is longer
COMPLETE = ("closed", "bracket")
INSIDE = ("omission", "broken", "open", "fragment", "pair2", "pair3")  # endings that whole texts have by mistake only
KINDS = (*COMPLETE, "remark", *INSIDE, "single0", "single1", "single2", "single3", "pair0", "pair1")
LEVELS = 20  # steps of the posterior


def _remark(last: Column) -> Column:
    """Whether a last line is complete without a stop; in part it may still have been cut at a limit."""
    keywords = F.lower(last).rlike("^(" + "|".join(KEYWORD_LINES) + r")\s*:\s*\S")
    signature = last.rlike(r"^(\p{Lu}[\p{L}]{0,2}\.[\s-]?){1,3}((von|van|de|di|du|der|la|le)\s)*\p{Lu}[\p{L}’'-]+(\s\p{Lu}[\p{L}’'-]+)?$")
    marks = last.rlike(r"^(doi:?\s*)?10\.[0-9]{4,}/\S+$") | last.rlike(r"^\(?\s*[0-9]+\s*[/|]\s*[0-9]+\s*\)?$") | last.rlike(r"^[*\s#~=_·•—–-]+$") | last.rlike(r"^https?://\S+$")
    return keywords | signature | marks


def _shape(sentence: Column) -> Column:
    """The first words and marks of a sentence as an array; names and numbers are masked."""
    words = F.slice(F.regexp_extract_all(sentence, F.lit(r"([\p{L}\p{M}’'-]+|[0-9]+|[^\s\p{L}\p{M}0-9])"), F.lit(1)), 1, WORDS)
    return F.transform(words, lambda w, i: F.when((i > 0) & w.rlike(r"^\p{Lu}"), "X").when(w.rlike("^[0-9]"), "9").otherwise(w))


def _first(words: Column, k) -> Column:
    return F.concat_ws(" ", F.slice(words, 1, k))


def endings(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(key, source, chars, bytes, kind, opener, form) of every text that isn't blank. kind: see KINDS, null
    where the opening of the last segment must tell: titles of one or two parts look like cut sentences."""
    t = F.rtrim(F.col(text), F.lit(" \t\r\n\f\u000b\u00a0\ufeff"))
    d = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), F.length(text).alias("chars"), F.octet_length(text).alias("bytes"), t.alias("t")).where("t IS NOT NULL AND t <> ''")
    d = d.withColumn("tail", F.right("t", F.lit(TAIL)))
    d = d.withColumn("broken", F.length("tail") - F.length(F.regexp_replace("tail", BROKEN_MARKUP, "")))
    d = d.withColumn("bare", F.when(F.col("broken") == 0, F.col("t")).otherwise(F.rtrim(F.expr("left(t, length(t) - broken)"), F.lit(" \t\r\n\u00a0"))))
    d = d.withColumn("line", F.substring_index(F.substring_index("bare", "\n", -1), "\r", -1)).withColumn("last", F.trim("line"))
    d = d.withColumn("more", F.length("line") < F.length("bare")).withColumn("sentences", F.split("last", BOUNDARY)).withColumn("end", F.element_at("sentences", -1)).withColumn("tail", F.right("bare", F.lit(TAIL)))
    unbalanced = F.length(F.translate("end", "(", "")) < F.length(F.translate("end", ")", ""))
    words = _shape(F.col("end"))
    whole = F.col("broken") == 0
    kind = (
        F.when(F.col("bare") == "", "broken").when(F.col("tail").rlike("\ufffd+$"), "broken").when(F.col("tail").rlike(ELLIPSIS), "omission")
        .when(F.col("tail").rlike(CLOSED) & ~unbalanced, "closed").when(whole & (F.size("sentences") > 1) & F.col("end").rlike(r"^(\[[^\[\]]{2,}\]|\([^()]{2,60}\))$"), "bracket")
        .when(whole & _remark(F.col("last")), "remark").when(~whole, "broken").when(F.size("sentences") > 2, "open").when(F.col("more"), F.when(F.size("sentences") > 1, "open").otherwise("fragment"))
    )
    opener = _first(words, F.least(F.lit(WORDS), F.greatest(F.lit(1), F.size(words) - 1)))
    return d.select("key", "source", "chars", "bytes", kind.alias("kind"), F.when(kind.isNull(), opener).alias("opener"), F.when(F.size("sentences") > 1, "pair").otherwise("single").alias("form"))


def openings(docs: DataFrame, alone: DataFrame, text: str = "text") -> DataFrame:
    """(opener, shut): how many closed sentences begin with these words, for the openers of `alone`. Sentences
    of another first word, and openings that aren't asked for, leave before the shuffle."""
    first, whole = sieve(alone.select(F.substring_index("opener", " ", 1).alias("w")).distinct(), "w"), sieve(alone, "opener")
    s = docs.where(F.col(text).isNotNull()).select(F.explode(F.split(F.col(text), BOUNDARY)).alias("p"))
    s = s.where(first(F.regexp_extract("p", r"^\s*([\p{L}\p{M}’'-]+|[0-9]+|[^\s])", 1)) | F.col("p").rlike(r"^\s*[0-9]")).where(F.rtrim("p").rlike(CLOSED))
    s = s.select(_shape(F.col("p")).alias("w"))
    s = s.select(F.explode(F.filter(F.transform(F.sequence(F.lit(1), F.size("w")), lambda k: _first(F.col("w"), k)), lambda o: whole(o))).alias("opener"))
    return s.groupBy("opener").agg(F.count("*").alias("shut")).join(alone.select("opener"), "opener", "left_semi")


def _phi(x: float) -> float:
    return math.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def _upper(x: float) -> float:
    return max(1e-300, math.erfc(x / math.sqrt(2)) / 2)


def censored_fit(count: float, first: float, second: float, limits: dict[float, float], rounds: int = 60) -> tuple[float, float]:
    """Mean and deviation of log-lengths by EM, from number, sum and sum of squares of the exact ones; at each
    limit so many texts are known only to be longer."""
    n = count + sum(limits.values())
    mean = first / max(1e-9, count)
    var = max(1e-6, second / max(1e-9, count) - mean * mean)
    for _ in range(rounds):
        dev = math.sqrt(var)
        s1, s2 = first, second
        for limit, m in limits.items():
            x = math.log(limit)
            h = _phi((x - mean) / dev) / _upper((x - mean) / dev)
            s1 += m * (mean + dev * h)
            s2 += m * (mean * mean + var + dev * h * (x + mean))
        new = s1 / n
        var = max(1e-6, s2 / n - new * new)
        if abs(new - mean) < 1e-9:
            break
        mean = new
    return mean, math.sqrt(var)


def censoring_posteriors(hist: DataFrame, least: int = 5, ratio: float = 6.0, width: float = 0.06) -> DataFrame:
    """(source, unit, size, posterior) of the candidate limits. hist: source, unit, size, n, n_open. A
    candidate stands out from the lengths within `width` in logarithm; only candidates and three sums of each
    source are gathered, not its histogram."""
    x = F.log(F.greatest("size", F.lit(1)).cast("double"))
    reach = round(width * 1e6)
    near = Window.partitionBy("source", "unit").orderBy(F.round(F.col("x") * 1e6).cast("bigint")).rangeBetween(-reach, reach)
    room = F.greatest(F.lit(1.0), F.col("size") * (math.exp(width) - math.exp(-width)))
    h = hist.withColumn("x", x).withColumn("expected", (F.sum("n").over(near) - F.col("n")) / room)
    stands = (F.col("n_open") >= least) & (F.col("n") > ratio * F.greatest("expected", F.lit(0.15)))
    per = h.groupBy("source", "unit").agg(
        F.sum("n").cast("double").alias("s0"), F.sum(F.col("n") * F.col("x")).alias("s1"), F.sum(F.col("n") * F.col("x") * F.col("x")).alias("s2"),
        F.collect_list(F.when(stands, F.struct("size", "n", "expected"))).alias("limits"),
    ).where("size(limits) > 0")

    def run(batches):
        import pandas as pd

        for b in batches:
            out = []
            for source, unit, s0, s1, s2, limits in zip(b["source"], b["unit"], b["s0"], b["s1"], b["s2"], b["limits"]):
                n = {r["size"]: r["n"] for r in limits}
                found = {r["size"]: r["n"] - r["expected"] for r in limits}
                for _ in range(2):
                    logs = {s: math.log(max(1, s)) for s in found}
                    mean, dev = censored_fit(s0 - sum(found.values()), s1 - sum(m * logs[s] for s, m in found.items()), s2 - sum(m * logs[s] ** 2 for s, m in found.items()), {max(1, s): m for s, m in found.items() if m > 0})
                    found = {s: max(0.0, n[s] - s0 * _phi((logs[s] - mean) / dev) / (dev * max(1, s))) for s in found}
                out += [(source, unit, s, min(0.999, m / n[s])) for s, m in found.items()]
            yield pd.DataFrame(out, columns=["source", "unit", "size", "posterior"])

    return per.mapInPandas(run, "source string, unit string, size bigint, posterior double")


def _cut_prior(level: float, rate: float) -> float:
    return min(1 - 1e-6, max(1e-6, 1 - (1 - level) * (1 - rate)))


def learn_endings(counts: dict[tuple[int, str], float], whole: dict[str, float], rounds: int = 80) -> tuple[dict[str, float], float]:
    """Log-ratio of each ending between cut and whole texts, and the rate of breaks away from limits. counts: by
    (level of the posterior, kind); whole: the shares of kinds among whole texts to begin with."""
    alpha = 0.5
    texts = sum(counts.values())
    base = {k: whole.get(k, 0.0) for k in KINDS}
    top: dict[str, float] = {}
    for (level, k), n in counts.items():
        top[k] = top.get(k, 0.0) + n * level / LEVELS + (n * 0.1 if k in INSIDE else 0.0)
    share = lambda d: {k: (d.get(k, 0.0) + alpha) / (sum(d.values()) + alpha * len(KINDS)) for k in KINDS}
    broken, sound, rate = share(top), {k: max(1e-7, v) for k, v in base.items()}, 0.02
    for _ in range(rounds):
        out, rest, hits, away = {}, {}, 0.0, 0.0
        for (level, k), n in counts.items():
            q = _cut_prior(level / LEVELS, rate)
            r = q * broken[k] / (q * broken[k] + (1 - q) * sound[k])
            out[k], rest[k] = out.get(k, 0.0) + n * r, rest.get(k, 0.0) + n * (1 - r)
            if not level:
                hits, away = hits + n * r, away + n
        if not texts:
            break
        # an open ending among whole texts is a mistake of the reader, at the rate that is given
        broken, sound, rate = share(out), {k: max(1e-7, base[k]) if k in INSIDE else v for k, v in share(rest).items()}, (hits + alpha) / (away + 1)
    return {k: math.log(broken[k] / sound[k]) for k in KINDS}, rate


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", slip: float = 0.002, fitted: bool = True) -> DataFrame:
    """(key, source, kind, odds): log-odds that a text was cut inside a word or sentence, for every text that
    isn't blank. slip: how often a whole text looks open at most; the sources may show that it's rarer.
    fitted=False leaves the lengths out."""
    spark = docs.sparkSession
    docs = spread(docs.select(key, text, source))
    ends = cut(endings(docs, key, text, source))
    alone = cut(ends.where("kind IS NULL").groupBy("opener").agg(F.count("*").alias("alone")))
    shut = alone.join(openings(docs, alone, text), "opener", "left").select("opener", F.log2((F.coalesce("shut", F.lit(0)) + 0.5) / F.col("alone")).alias("r"))
    shut = shut.select("opener", F.when(F.col("r") <= -1, "0").when(F.col("r") <= 0.5, "1").when(F.col("r") <= 2.5, "2").otherwise("3").alias("rank"))
    src = F.coalesce("source", F.lit("\0")).alias("src")
    ends = cut(ends.where("kind IS NOT NULL").unionByName(ends.where("kind IS NULL").join(shut, "opener").withColumn("kind", F.concat("form", "rank")).drop("rank")).drop("opener", "form").withColumn("src", src))

    sizes = F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("size")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("size")))).alias("s")
    hist = ends.select("src", sizes, F.col("kind").isin(*INSIDE).alias("o")).groupBy(F.col("src").alias("source"), "s.unit", F.col("s.size").cast("bigint").alias("size")).agg(F.count("*").alias("n"), F.sum(F.col("o").cast("int")).alias("n_open"))
    at = cut(censoring_posteriors(hist)) if fitted else spark.createDataFrame([], "source string, unit string, size bigint, posterior double")
    for unit in ("chars", "bytes"):
        ends = ends.join(at.where(F.col("unit") == unit).select(F.col("source").alias("src"), F.col("size").cast("int").alias(unit), F.col("posterior").alias("post_" + unit)), ["src", unit], "left")
    post = F.greatest(F.coalesce("post_chars", F.lit(0.0)), F.coalesce("post_bytes", F.lit(0.0)))
    ends = cut(ends.select("key", "source", "src", "kind", F.round(post * LEVELS).cast("int").alias("level")))

    per = cut(ends.groupBy("src", "level", "kind").agg(F.count("*").alias("n")))
    counts = {(r["level"], r["kind"]): float(r["n"]) for r in per.groupBy("level", "kind").agg(F.sum("n").alias("n")).collect()}  # at most levels x kinds rows
    # the sources whose texts away from limits are open least tell what whole texts look like
    inside = F.sum(F.when(F.col("kind").isin(*INSIDE), F.col("n")).otherwise(0))
    rates = per.where("level = 0").groupBy("src").agg(F.sum("n").alias("all"), inside.alias("open"))
    slip = min(slip, rates.agg(F.min((F.col("open") + 0.5) / (F.col("all") + 50))).first()[0] or slip)  # a source of few texts tells little
    away = {k: sum(n for (level, x), n in counts.items() if x == k and not level) for k in KINDS}
    total = sum(away.values()) or 1.0
    opened = sum(away[k] for k in INSIDE) or 1.0
    whole = {k: slip * away[k] / opened if k in INSIDE else away[k] / total for k in KINDS}
    ratios, rate = learn_endings(counts, whole)

    def settle(pdf):
        import pandas as pd

        own = rate
        for _ in range(30):  # a source of few texts keeps the rate of all
            hits = all_ = 0.0
            for level, k, n in zip(pdf["level"], pdf["kind"], pdf["n"]):
                if not level:
                    z = math.exp(ratios[k]) * own / (1 - own)
                    hits, all_ = hits + n * z / (1 + z), all_ + n
            own = min(0.999, max(1e-5, (hits + 20 * rate) / (all_ + 20)))
        return pd.DataFrame({"src": [pdf["src"].iloc[0]], "rate": [own]})

    own = per.groupBy("src").applyInPandas(settle, "src string, rate double")  # at most levels x kinds rows a source
    q = 1 - (1 - F.col("level") / LEVELS) * (1 - F.col("rate"))
    q = F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), q))
    ratio = F.coalesce(*[F.when(F.col("kind") == k, v) for k, v in ratios.items()])
    odds = F.when(F.col("kind").isin(*COMPLETE), F.lit(float("-inf"))).otherwise(ratio + F.log(q / (1 - q)))
    return ends.join(own, "src").select(F.col("key").alias(key), "source", "kind", odds.alias("odds"))


def shares(judged: DataFrame) -> DataFrame:
    """(source, n, n_cut, share) - how often each source truncates."""
    return judged.groupBy("source").agg(F.count("*").alias("n"), F.sum((F.col("odds") > 0).cast("bigint")).alias("n_cut")).withColumn("share", F.col("n_cut") / F.col("n"))
