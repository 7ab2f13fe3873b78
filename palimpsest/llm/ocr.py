"""Noise in text from scanned pages (problem 5).

1. Page furniture. Units that may be page numbers, running headers (the first words of the title) or names
   standing over a page are found in each document; neighbouring units form a cluster. Counts of
   neighbouring tokens over the corpus tell whether the text reads on across a cluster; numbers that
   count on from page to page support each other. What is furniture leaves the text.
2. Words. A lexicon of frequent types and counts of bigrams are taken from what is left. A symmetric-delete
   index over the lexicon, and an index of forms in which all confusions are folded, give candidates for
   every other type; a weighted edit distance with confusion pairs keeps those that may be meant. Which of
   them is meant, or whether the word stays, the bigrams at each place decide together with frequency and
   distance. Types that fall into lexicon words which follow each other elsewhere are words run together;
   neighbours whose concatenation is a far more frequent word are its pieces, with or without a hyphen, and
   where both pieces are words themselves the bigrams around decide. Of two repairs of one element the one
   with the better bigrams is made, for all elements it covers.

Counts cover the whole corpus, decisions are made per type or bigram type by joins; nothing of the corpus
is collected or broadcast.

Defined results: null or empty lexical_features give no rows; null tokens are no cases and separate their
neighbours; a null title has no header; repeated doc_ids are repaired each for itself but their flags come
out once; a corpus without any frequent type only loses its furniture.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import osa
from ..session import cut, sieve, spread

# Characters and groups that scanners take for each other.
CONFUSIONS = (
    ("m", "rn"), ("m", "in"), ("m", "nn"), ("d", "cl"), ("d", "ol"), ("w", "vv"), ("u", "ii"), ("n", "ri"), ("n", "ii"), ("h", "li"), ("h", "b"), ("e", "c"), ("t", "f"), ("f", "t"),
    ("rn", "m"), ("in", "m"), ("ni", "m"), ("nn", "m"), ("cl", "d"), ("ii", "u"), ("vv", "w"), ("ri", "n"), ("li", "h"), ("b", "h"), ("o", "0"), ("l", "1"), ("i", "1"), ("i", "l"), ("l", "i"), ("i", "!"), ("l", "!"), ("a", "@"), ("g", "9"), ("g", "q"), ("s", "5"), ("s", "ſ"), ("s", "f"), ("b", "8"), ("b", "6"), ("z", "2"),
    ("fi", "ﬁ"), ("fl", "ﬂ"), ("ff", "ﬀ"), ("n", "u"), ("u", "n"), ("c", "e"), ("o", "c"), ("B", "8"), ("S", "5"), ("I", "l"), ("I", "1"), ("O", "0"), ("l", "I"), ("T", "7"), ("st", "ﬅ"),
)
HYPHENS = "-­‐‑‒–—¬="
DASHES = {"-", "‐", "‑", "‒", "–", "—", "―", "[", "]", "|", "*", "·", "•", "~"}
DIGIT_FOR = str.maketrans({"l": "1", "I": "1", "|": "1", "!": "1", "i": "1", "O": "0", "o": "0", "S": "5", "s": "5", "B": "8", "Z": "2", "z": "2", "g": "9", "q": "9"})
CANON = str.maketrans({"0": "o", "1": "i", "l": "i", "|": "i", "!": "i", "@": "a", "5": "s", "8": "b", "9": "g", "ſ": "s", "q": "g"})
ROMAN = re.compile(r"^(?=.)c{0,3}(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$")

QUOTES = {"“", "„", "«", "‘", "‹", '"'}
START, END, NUMBER, NULL = "\x02", "\x03", "<n>", "\x00"


_BY_END: dict[tuple[str, str], list[tuple[str, str]]] = {}
for _x, _y in CONFUSIONS:
    _BY_END.setdefault((_x[-1], _y[-1]), []).append((_x, _y))


def edit_distance(a: str, b: str, limit: float) -> float:
    """Weighted distance from the right form a to the read form b; limit + 1 beyond the limit."""
    if abs(len(a) - len(b)) > 2 * limit + 2:
        return limit + 1
    n, m = len(a), len(b)
    rows = [[j * 1.0 for j in range(m + 1)]]
    for j in range(2, m + 1):
        if b[j - 1] == b[j - 2]:
            rows[0][j] = rows[0][j - 1] + 0.6
    least = [0.0]
    get = _BY_END.get
    for i in range(1, n + 1):
        above, x, row = rows[-1], a[i - 1], [i * 1.0] + [0.0] * m
        for j in range(1, m + 1):
            y = b[j - 1]
            if x == y:
                best = above[j - 1]
            else:
                best = above[j - 1] + 1
            v = above[j] + 1
            if v < best:
                best = v
            v = row[j - 1] + (0.6 if j > 1 and y == b[j - 2] else 1)
            if v < best:
                best = v
            if x != y and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y and rows[i - 2][j - 2] + 1 < best:
                best = rows[i - 2][j - 2] + 1
            for p, q in get((x, y), ()):
                if i >= len(p) and j >= len(q) and a[i - len(p) : i] == p and b[j - len(q) : j] == q and rows[i - len(p)][j - len(q)] + 0.3 < best:
                    best = rows[i - len(p)][j - len(q)] + 0.3
            row[j] = best
        rows.append(row)
        least.append(min(row))
        if i > 1 and least[-1] > limit and least[-2] > limit:
            return limit + 1
    return min(rows[n][m], limit + 1)


def _value(t: str) -> int:
    """The number a token may stand for, misread digits included; 0 if none."""
    if t.isdigit() and t.isascii():
        return int(t) if len(t) <= 4 else 0
    if 2 <= len(t) <= 4 and (any(c.isdigit() for c in t) or (len(t) == 3 and set(t) <= set("lO|I!"))) and (x := t.translate(DIGIT_FOR)).isdigit() and x.isascii():
        return int(x)
    if t.islower() and ROMAN.match(t):
        total = 0
        for c, after in zip(t, [*t[1:], ""]):
            v = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}[c]
            total += -v if after and v < {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}[after] else v
        return total
    return 0


@lru_cache(1 << 17)
def _canon(t: str) -> str:
    return t.casefold().translate(CANON)


@lru_cache(1 << 18)
def _like(a: str, b: str) -> bool:
    a, b = _canon(a), _canon(b)
    if a == b:
        return True
    if min(len(a), len(b)) < 4 or abs(len(a) - len(b)) > 1 + max(len(a), len(b)) // 8:
        return False
    limit = 1 if len(a) < 10 else 2
    return osa(a, b, limit) <= limit or (a[0] == b[0] and a[-1] == b[-1] and edit_distance(a, b, limit) <= limit)


def title_words(title: str | None) -> list[str]:
    t = re.sub(r"<[^>]*>", " ", html.unescape(title or ""))
    return re.findall(r"[\w@!]+(?:['’\-‐‑][\w@!]+)*['’]?", t)


def _units(tokens: list[str], title: list[str]) -> list[tuple[int, int, str, int]]:
    """(start, end, kind, value) of what may be furniture; kinds: page (between dashes), number, title, name, capitals."""
    out, i, n = [], 0, len(tokens)
    while i < n:
        t, m = tokens[i], 0
        while m < len(title) and i + m < n and _like(title[m], tokens[i + m]):
            m += 1
        if (m >= 3 or (m >= 2 and m == len(title))) and not (i and tokens[i - 1] in QUOTES):
            out.append((i, i + m, "title", 0))
            i += m
            continue
        if t in DASHES and i + 2 < n and tokens[i + 2] in DASHES and (v := _value(tokens[i + 1])) and {t, tokens[i + 2]} != {"[", "]"}:
            out.append((i, i + 3, "page", v))
            i += 3
            continue
        if m >= 2 and i and tokens[i - 1] in QUOTES:  # a title that is quoted
            i += m
            continue
        if (v := _value(t)) and (len(t) > 1 or t.isdigit()):
            out.append((i, i + 1, "number", v))
        elif len(t) == 1 and t.isupper() and i + 2 < n and tokens[i + 1] == "." and tokens[i + 2][:1].isupper() and len(tokens[i + 2]) > 2:
            end = i + 3
            out.append((i, end, "name", 0))
            i = end
            continue
        elif len(t) > 3 and sum(c.isupper() for c in t) >= 0.6 * len(t) and not ROMAN.match(t.lower()):
            out.append((i, i + 1, "capitals", 0))
        elif m == 2:
            out.append((i, i + 2, "part", 0))
            i += 2
            continue
        i += 1
    return out


def _clusters(units: list) -> list[list]:
    out: list[list] = []
    for u in units:
        if out and out[-1][-1][1] == u[0]:
            out[-1].append(u)
        else:
            out.append([u])
    return out


def _masked(t: str | None) -> str:
    return NULL if t is None else NUMBER if t.isdigit() else t


def _chain(numbers: list[tuple[int, int, int]]) -> set[int]:
    """Places of the heaviest run of numbers that count on from page to page. numbers: place, value, weight."""
    best: list[tuple[int, int, int]] = []  # weight, length, the one before
    of: dict[int, int] = {}  # the best place so far of each value
    for i, (_, v, w) in enumerate(numbers):
        weight, length, back = w, 1, -1
        for step in (1, 2, 3):
            j = of.get(v - step)
            if j is not None and best[j][0] + w - 2 * (step - 1) > weight:
                weight, length, back = best[j][0] + w - 2 * (step - 1), best[j][1] + 1, j
        best.append((weight, length, back))
        if v not in of or best[i] > best[of[v]]:
            of[v] = i
    if not best:
        return set()
    i = max(range(len(best)), key=lambda i: best[i])
    if best[i][1] < 2 or best[i][0] < 4:
        return set()
    out = set()
    while i >= 0:
        out.add(numbers[i][0])
        i = best[i][2]
    return out


def furniture(tokens: list, title: str | None, counts: dict[int, tuple]) -> set[int]:
    """Positions of furniture. counts, by a cluster's start: of (before, after), (before, <n>), (<n>, after) and of the cluster's first token."""
    clusters = _clusters(_units(["" if t is None else t for t in tokens], title_words(title)))
    numbers, facts = [], []
    for c in clusters:
        kinds = {u[2] for u in c}
        skip, before, after, own = counts.get(c[0][0], (0, 0, 0, 0))
        reads_on = skip >= 3 and skip > 2 * min(before, after)
        marked = bool(kinds & {"page", "title"})
        sure = marked or (bool(kinds & {"number", "name"}) and reads_on) or ("capitals" in kinds and "number" not in kinds and reads_on and own * 50 < skip)
        in_prose = skip == 0 and before > 5 and after > 5
        facts.append((c, sure, in_prose))
        for u in c:
            if u[3]:
                weight = 6 if u[2] == "page" else 3 if sure and (reads_on or not in_prose) else 0 if in_prose and len(c) == 1 else 1
                if weight:
                    numbers.append((u[0], u[3], weight))
    chain = _chain(numbers)
    out: list[tuple] = []
    rest = []
    for c, sure, in_prose in facts:
        pages = [u for u in c if u[3]]
        linked = [u for u in pages if u[0] in chain]
        if not (sure or linked or (len(c) > 1 and pages and not in_prose)):
            rest.append(c)
            continue
        if linked:
            keep = linked
        elif any(u[2] == "page" for u in pages):
            keep = [u for u in pages if u[2] == "page"]
        else:  # with a chain elsewhere, a number outside it belongs to the text
            keep = pages[-1:] if not chain and sure else []
        if not keep and pages and all(u[2] == "number" for u in c):
            continue
        out += [u for u in c if u in keep or not u[3]]
    names = {_canon(tokens[u[1] - 1]) for u in out if u[2] in ("name", "capitals")}
    out += [u for c in rest for u in c if u[2] == "name" and _canon(tokens[u[1] - 1]) in names]
    return {i for u in out for i in range(u[0], u[1])}


def _documents(corpus: DataFrame) -> DataFrame:
    d = corpus.where("lexical_features IS NOT NULL AND size(lexical_features) > 0")
    return d.select(F.xxhash64(*[F.col(c) for c in ("doc_id", "title")], F.col("lexical_features")).alias("key"), "doc_id", "title", F.transform("lexical_features", lambda x: x["token"]).alias("tokens"))


def _bigrams(d: DataFrame, masked: bool) -> DataFrame:
    """(a, b, n) over neighbouring tokens, START and END included."""
    t = F.transform("tokens", lambda x: F.when(x.isNull(), NULL).when(x.rlike("^[0-9]+$"), NUMBER).otherwise(x) if masked else F.coalesce(x, F.lit(NULL)))
    t = F.concat(F.array(F.lit(START)), t, F.array(F.lit(END)))
    pairs = d.select(t.alias("t")).select(F.explode(F.arrays_zip(F.slice("t", F.lit(1), F.size("t") - 1).alias("a"), F.slice("t", F.lit(2), F.size("t") - 1).alias("b"))).alias("p"))
    return pairs.groupBy("p.a", "p.b").agg(F.count("*").alias("n"))


def prose(corpus: DataFrame) -> DataFrame:
    """(doc_id, tokens, at, furniture): the tokens that stay, their places, and the places of furniture."""
    d = cut(spread(_documents(corpus)))
    bigrams = cut(_bigrams(d, True))

    def find(batches: Iterator) -> Iterator:
        import pandas as pd

        for b in batches:
            rows = []
            for key, title, tokens in zip(b["key"], b["title"], b["tokens"]):
                t = ["" if x is None else x for x in tokens]
                for c in _clusters(_units(t, title_words(title))):
                    lo, hi = c[0][0], c[-1][1]
                    rows.append((key, lo, _masked(tokens[lo - 1]) if lo else START, _masked(tokens[hi]) if hi < len(t) else END, t[lo]))
            yield pd.DataFrame(rows, columns=["key", "lo", "before", "after", "first"])

    found = d.select("key", "title", "tokens").mapInPandas(find, "key bigint, lo int, before string, after string, first string")
    firsts = bigrams.groupBy(F.col("a").alias("first")).agg(F.sum("n").alias("own"))
    counted = (
        found.join(bigrams.select(F.col("a").alias("before"), F.col("b").alias("after"), F.col("n").alias("skip")), ["before", "after"], "left")
        .join(bigrams.where(F.col("b") == NUMBER).select(F.col("a").alias("before"), F.col("n").alias("lead")), "before", "left")
        .join(bigrams.where(F.col("a") == NUMBER).select(F.col("b").alias("after"), F.col("n").alias("follow")), "after", "left")
        .join(firsts, "first", "left").na.fill(0).groupBy("key").agg(F.collect_list(F.struct("lo", "skip", "lead", "follow", "own")).alias("clusters"))
    )

    def settle(batches: Iterator) -> Iterator:
        for b in batches:
            kept, places, gone = [], [], []
            for title, tokens, clusters in zip(b["title"], b["tokens"], b["clusters"]):
                f = furniture(list(tokens), title, {c["lo"]: (c["skip"], c["lead"], c["follow"], c["own"]) for c in (clusters if clusters is not None else [])})
                at = [i for i in range(len(tokens)) if i not in f]
                kept.append([tokens[i] for i in at])
                places.append(at)
                gone.append(sorted(f))
            yield b[["doc_id"]].assign(tokens=kept, at=places, furniture=gone)

    # a key holds the same document, should it stand in the table twice
    return d.join(counted.dropDuplicates(["key"]), "key", "left").select("doc_id", "title", "tokens", "clusters").mapInPandas(settle, "doc_id string, tokens array<string>, at array<int>, furniture array<int>")


def _deletes(word, prefix: int = 9):
    """All ways to drop up to two characters of a word's prefix, each once."""
    p = F.substring(word, 1, prefix)
    one = F.transform(F.sequence(F.lit(1), F.length(p)), lambda i: F.concat(F.substring(p, F.lit(1), i - 1), p.substr(i + 1, F.lit(prefix))))
    two = F.flatten(F.transform(one, lambda w: F.when(F.length(w) > 2, F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), w.substr(i + 1, F.lit(prefix))))).otherwise(F.array().cast("array<string>"))))
    return F.array_distinct(F.concat(F.array(p), one, two))


def _index(word):
    """Keys under which a word and its misread forms meet: deletes, and strokes for words full of confusions."""
    return F.concat(_deletes(word), F.when(F.length(word) >= 5, F.array(F.concat(F.lit("\x04"), _strokes(word)))).otherwise(F.array().cast("array<string>")))


def _strokes(word):
    """A word with all letters that are taken for each other, and groups of them, written alike."""
    one = word
    for x, y in (("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬅ", "st")):
        one = F.replace(one, F.lit(x), F.lit(y))
    one = F.translate(one, "0Oo1l!I|rj@958B6SsſfTtq72ec", "ccciiiiiiiagtbbbttttttgtzcc")
    for x, y in (("m", "iii"), ("[nuhb]", "ii"), ("d", "ci"), ("w", "vv")):
        one = F.regexp_replace(one, x, y)
    return one


def damaged_types(types: DataFrame, bigrams: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """(token, word, n, score) of all words a type may be misread from, and (token, repair) of types that are
    words run together. types: token, n; least: a lexicon word's count."""
    letters = r"^[\p{L}][\p{L}\p{M}'’\-]*$"
    lexicon = types.where((F.col("n") >= least) & F.col("token").rlike(letters) & (F.length("token") > 1))
    strange = types.where(F.col("token").rlike(r"[\p{L}]") & (F.length("token") > 1))

    # misread: candidates by the symmetric-delete index
    pairs = (
        strange.where(F.length("token") > 2).select("token", "n", F.explode(_index(F.col("token"))).alias("k"))
        .join(lexicon.where(F.length("token") > 2).select(F.col("token").alias("word"), F.col("n").alias("m"), F.explode(_index(F.col("token"))).alias("k")), "k")
        .where((F.col("word") != F.col("token")) & (F.col("n") * 8 <= F.col("m")) & (F.abs(F.length("word") - F.length("token")) <= 3)).select("token", "word", "n", "m").distinct()
    )

    def weigh(batches: Iterator) -> Iterator:
        for b in batches:
            yield b.assign(cost=[edit_distance(w, t, 1.3) for w, t in zip(b["word"], b["token"])])

    cased = F.col("token").rlike(r"^\p{Lu}")
    rare = F.col("n") * 40 <= F.col("m")
    strong = F.when(cased, (F.col("cost") <= 0.6) & (F.col("n") * 200 <= F.col("m"))).otherwise((F.col("cost") <= 0.31) | (rare & F.when(F.length("word") < 5, F.col("cost") <= 0.6).otherwise(F.col("cost") <= 1.21)))
    odd = F.col("token").rlike(r"^(?=.*[\p{L}])(?=.*[0-9@!ſﬁﬂﬀ])")
    misread = pairs.mapInPandas(weigh, "token string, word string, n bigint, m bigint, cost double").where(strong | (odd & (F.col("cost") <= 1.3)))
    misread = misread.select("token", "word", "n", (F.log("m") - 6 * F.col("cost")).alias("score"))
    # characters that no word has: the plain form is a type of the corpus
    plain = strange.where(odd).withColumn("word", F.translate(F.regexp_replace(F.regexp_replace("token", "ﬁ", "fi"), "ﬂ", "fl"), "01@!958ſ", "olaigsbs"))
    plain = plain.join(types.select(F.col("token").alias("word"), F.col("n").alias("m")), "word").where("word <> token AND m > 1").select("token", "word", "n", F.log("m").alias("score"))
    misread = misread.unionByName(plain).groupBy("token", "word", "n").agg(F.max("score").alias("score"))

    # run together: all lexicon words inside a type, then the best way through it
    inside = strange.where((F.length("token") >= 5) & F.col("token").rlike(letters))
    spans = inside.select("token", "n", F.explode(F.sequence(F.lit(1), F.length("token"))).alias("i")).select("token", "n", "i", F.explode(F.sequence(F.lit(1), F.length("token") - F.col("i") + 1)).alias("l"))
    spans = spans.where(F.col("l") < F.length("token")).select("token", "n", "i", "l", F.expr("substring(token, i, l)").alias("word"))
    words = types.where((F.col("n") > 1) & F.col("token").rlike(letters) & ((F.length("token") > 1) | F.col("token").isin("a", "I", "A"))).select(F.col("token").alias("word"), F.col("n").alias("m"))
    hits = spans.join(words, "word").where("m >= 5 * n").groupBy("token").agg(F.first("n").alias("n"), F.collect_list(F.struct("i", "l", "m")).alias("hits"))

    def through(batches: Iterator) -> Iterator:
        import math

        for b in batches:
            ways = []
            for t, found in zip(b["token"], b["hits"]):
                best: list = [None] * (len(t) + 1)
                best[0] = (0.0, [])
                for h in sorted(found, key=lambda h: h["i"]):
                    i, j = h["i"] - 1, h["i"] - 1 + h["l"]
                    if best[i] and (best[j] is None or best[i][0] + math.log(h["m"]) - 20 > best[j][0]):
                        best[j] = (best[i][0] + math.log(h["m"]) - 20, [*best[i][1], t[i:j]])
                ways.append(best[-1][1] if best[-1] else [])
            yield b[["token", "n"]].assign(words=ways)

    cuts = hits.mapInPandas(through, "token string, n bigint, words array<string>").where("size(words) > 1")
    steps = cuts.select("token", "n", "words", F.explode(F.arrays_zip(F.slice("words", F.lit(1), F.size("words") - 1).alias("a"), F.slice("words", F.lit(2), F.size("words") - 1).alias("b"))).alias("p"))
    joined = steps.select("token", "n", "words", "p.a", "p.b").join(bigrams.withColumnRenamed("n", "nn"), ["a", "b"], "left")
    together = joined.groupBy("token").agg(F.min(F.coalesce("nn", F.lit(0)) - F.col("n")).alias("worst"), F.first(F.array_join("words", " ")).alias("repair")).where("worst >= 1").select("token", "repair")
    return misread.join(together, "token", "left_anti"), together


def chosen_words(places: DataFrame, candidates: DataFrame, bigrams: DataFrame, context: bool = True) -> DataFrame:
    """(before, token, after, repair, evidence): the word each distinct place of a doubtful type has, by
    frequency, distance and the bigrams with its neighbours; a place where the type itself fits best gives no
    row. places: before, token, after; context=False leaves the neighbours out."""
    stays = candidates.groupBy("token", "n").agg(F.lit(1)).select("token", F.col("token").alias("word"), "n", F.log("n").alias("score"))
    tried = places.distinct().join(candidates.unionByName(stays), "token")
    n = bigrams.select(F.col("a").alias("_a"), F.col("b").alias("_b"), "n")
    for name, x, y in (("left", "before", "word"), ("right", "word", "after")):
        tried = tried.join(n.select("_a", "_b", F.col("n").alias(name)), (F.col(x) == F.col("_a")) & (F.col(y) == F.col("_b")), "left").drop("_a", "_b")
    own = F.when(F.col("word") == F.col("token"), 1).otherwise(0)  # the place itself is no evidence
    seen = [F.greatest(F.lit(0), F.coalesce(c, F.lit(0)) - own) for c in ("left", "right")]
    tried = tried.withColumn("evidence", seen[0] + seen[1]).withColumn("total", F.col("score") + ((F.log1p(seen[0]) + F.log1p(seen[1])) if context else F.lit(0.0)))
    best = tried.groupBy("before", "token", "after").agg(F.max(F.struct("total", "evidence", "word")).alias("b"))
    return best.select("before", "token", "after", F.col("b.word").alias("repair"), F.col("b.evidence").alias("evidence")).where("repair <> token")


def broken_words(types: DataFrame, bigrams: DataFrame) -> DataFrame:
    """(a, b, word, open) of neighbours that are pieces of one word; open: both are words themselves, the
    place must decide."""
    hyphen = "[" + re.escape(HYPHENS) + "]$"
    letters = F.col("b").rlike(r"^[\p{L}\-]") & F.col("a").rlike(r"^[\p{L}]")
    bare = F.regexp_replace("a", hyphen, "")
    ways = F.when(F.col("a").rlike(hyphen), F.array(F.concat(bare, "b"), F.concat(bare, F.lit("-"), "b"))).otherwise(F.array(F.concat("a", "b")))
    pairs = bigrams.where(letters).select("a", "b", "n", F.explode(ways).alias("word")).join(types.select(F.col("token").alias("word"), F.col("n").alias("m")), "word")
    pairs = pairs.join(types.select(F.col("token").alias("a"), F.col("n").alias("na")), "a").join(types.select(F.col("token").alias("b"), F.col("n").alias("nb")), "b")
    hyphened = F.col("a").rlike(hyphen)
    frequent = F.col("m") >= 20 * F.col("n")
    fresh = (F.col("na") == F.col("n")) & (F.col("nb") == F.col("n")) & (F.col("m") >= 2)
    alone = (F.col("na") * 4 > F.col("m")) & (F.col("nb") * 4 > F.col("m"))
    return pairs.where(hyphened & (frequent | (F.col("m") >= 2)) | frequent | fresh).groupBy("a", "b").agg(F.max_by("word", "m").alias("word"), F.max("m").alias("m"), F.first("n").alias("n"), F.first(~hyphened & alone).alias("open"))


def repairs(corpus: DataFrame, context: bool = True) -> DataFrame:
    """(doc_id, idx, kind, repair) of every damaged element; repair is null for furniture and for the
    second piece of a word. context=False picks misread words without their neighbours."""
    p = cut(prose(corpus))
    bigrams = cut(_bigrams(p, False))
    types = cut(bigrams.where(F.col("a") != START).groupBy(F.col("a").alias("token")).agg(F.sum("n").alias("n")))
    total = types.agg(F.sum("n")).first()[0] or 0
    doubtful, together = (cut(x) for x in damaged_types(types, bigrams, 3 + 2e-5 * total))
    pieces = cut(broken_words(types, bigrams))
    pair = lambda a, b: F.concat(a, F.lit("\x04"), b)
    bad = sieve(doubtful.select("token").unionAll(together.select("token")), "token")
    broken = sieve(pieces.select(pair(F.col("a"), F.col("b")).alias("p")), "p")
    gone = p.select("doc_id", F.explode("furniture").alias("idx")).select("doc_id", "idx", F.lit("furniture").alias("kind"), F.lit(None).cast("string").alias("repair"))

    t = F.concat(F.array(F.lit(START)), F.transform("tokens", lambda x: F.coalesce(x, F.lit(NULL))), F.array(F.lit(END)))
    rows = p.select("doc_id", "at", t.alias("t")).select("doc_id", F.transform("at", lambda x, i: F.struct(
        x.alias("idx"), F.element_at("t", i + 1).alias("before"), F.element_at("t", i + 2).alias("token"), F.element_at("t", i + 3).alias("b"),
        F.when(i + 4 <= F.size("t"), F.element_at("t", F.least(i + 4, F.size("t")))).alias("after"), F.when(i + 1 < F.size("at"), F.element_at("at", F.least(i + 2, F.size("at")))).alias("next"))).alias("r"))
    # only elements that may be damaged leave their document
    rows = cut(rows.select("doc_id", F.explode(F.filter("r", lambda r: bad(r["token"]) | broken(pair(r["token"], r["b"])))).alias("r")).select("doc_id", "r.*"))
    alone = rows.select("doc_id", "idx", "before", "token", F.col("b").alias("after"))
    chosen = chosen_words(alone.join(doubtful.select("token").distinct(), "token", "left_semi").select("before", "token", "after"), doubtful, bigrams, context)
    wrong = alone.join(chosen, ["before", "token", "after"]).select("doc_id", "idx", "repair", "evidence")
    wrong = cut(wrong.unionByName(alone.join(together, "token").select("doc_id", "idx", "repair", F.lit(0).cast("bigint").alias("evidence"))))

    # pieces: the bigrams around, also of the pieces as words
    known = rows.withColumnRenamed("token", "a").join(pieces, ["a", "b"])
    n = bigrams.withColumnRenamed("n", "nn")
    for name, x, y in (("left", "before", "word"), ("right", "word", "after"), ("keep_l", "before", "a"), ("keep_r", "b", "after")):
        known = known.join(n.select(F.col("a").alias("_x"), F.col("b").alias("_y"), F.col("nn").alias(name)), (F.col(x) == F.col("_x")) & (F.col(y) == F.col("_y")), "left").drop("_x", "_y")
    known = known.na.fill(0, ["left", "right", "keep_l", "keep_r"]).where("NOT open OR ((left > 1 OR right > 1) AND left + right > 2 * (keep_l + keep_r - 2))")
    split = cut(known.select("doc_id", "idx", "next", F.col("word").alias("repair"), (F.col("left") + F.col("right")).alias("evidence")))
    # a piece that was misread as well: one of the two repairs is made
    both = split.select("doc_id", F.col("idx").alias("first"), F.explode(F.array("idx", "next")).alias("idx"), "evidence")
    met = both.join(wrong.select("doc_id", "idx", F.col("evidence").alias("other")), ["doc_id", "idx"])
    lost = met.groupBy("doc_id", F.col("first").alias("idx")).agg(F.max(F.col("other") > F.col("evidence")).alias("lost")).where("lost")
    split = split.join(lost, ["doc_id", "idx"], "left_anti")
    wrong = wrong.join(split.select("doc_id", F.explode(F.array("idx", "next")).alias("idx")), ["doc_id", "idx"], "left_anti").select("doc_id", "idx", F.lit("misread").alias("kind"), "repair", "evidence")
    split = split.select("doc_id", "evidence", F.explode(F.array(F.struct(F.col("idx"), F.col("repair")), F.struct(F.col("next").alias("idx"), F.lit(None).cast("string").alias("repair")))).alias("s")).select("doc_id", "s.idx", F.lit("split").alias("kind"), "s.repair", "evidence")
    every = gone.withColumn("evidence", F.lit(None).cast("bigint")).unionByName(wrong).unionByName(split)
    rank = F.when(F.col("kind") == "furniture", 2).when(F.col("kind") == "split", 1).otherwise(0)
    best = every.groupBy("doc_id", "idx").agg(F.max(F.struct(rank.alias("rank"), "evidence", "kind", "repair")).alias("b"))
    return best.select("doc_id", "idx", "b.kind", "b.repair")


def continuous(corpus: DataFrame, fixes: DataFrame, sentences: int = 8) -> DataFrame:
    """(doc_id, text): the repaired text of every document in paragraphs of so many sentences or a few more -
    the tokens don't tell where the author's began. Of documents under one doc_id the first by content counts."""
    per = fixes.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("idx", F.coalesce("repair", F.lit(""))))).alias("fix"))
    d = corpus.where("lexical_features IS NOT NULL").select("doc_id", F.transform("lexical_features", lambda x: x["token"]).alias("tokens"))
    d = d.groupBy("doc_id").agg(F.min_by("tokens", F.xxhash64("tokens")).alias("tokens")).join(per, "doc_id", "left")

    def run(batches: Iterator) -> Iterator:
        for b in batches:
            texts = []
            for tokens, fix in zip(b["tokens"], b["fix"]):
                fix = {} if fix is None else dict(fix)
                words = [w for i, t in enumerate(tokens) if (w := fix.get(i, t))]
                texts.append("\n\n".join(paragraphs(words, sentences)))
            yield b[["doc_id"]].assign(text=texts)

    return d.mapInPandas(run, "doc_id string, text string")


CLOSING, OPENING = set(".,;:!?)]}»”’…%"), set("([{«“„‘")


def paragraphs(words: list[str], sentences: int) -> list[str]:
    """Text with signs set as print sets them: closing ones behind their word, opening ones before it, straight
    quotation marks by turns."""
    out: list[str] = []
    text, glue, quoted, ends = "", True, False, 0
    for w in words:
        closes = w in CLOSING or w in ("'", "’s", "'s", "n't") or (w == '"' and quoted) or w.startswith(("’", "'")) and len(w) < 4
        if ends >= sentences and not closes and not quoted and (w[:1].isupper() or w in OPENING or w == '"'):
            out.append(text)
            text, glue, ends = "", True, 0
        text += w if glue or closes else " " + w
        if w == '"':
            quoted = not quoted
        glue = w in OPENING or (w == '"' and quoted)
        ends += w in (".", "!", "?", "…")
    return out + [text] if text else out
