"""Variant spellings of names typed by people (problem 4).

Names are brought into forms (family name, given names, or the words of an organisation); the distinct
forms, not the rows, are compared. Suffix blocking: every token's suffixes from a minimum length on are
index keys; a suffix that is too common is refined with the other part of the name, in two steps of growing
length. Forms under a key that is common even then meet by whole names with letters left out, so that forms of
one popular family name which differ in an edit still meet, and forms of initials by family name and letter;
no key is dropped. Words are compared by the ratio of their longest common subsequence, against a threshold by
length; a native bound on the family names keeps most pairs from it. Initials, nicknames, transliteration
and swapped parts are allowed for. Forms that agree in full names make clusters; a cluster of initials joins the only cluster
of full names that fits.

Identifiers (IdRef, VIAF, ORCID, ISNI) decide over names: rows that a chain of shared identifiers joins are one person, and a cluster
in which two chains hold valid identifiers of one kind names several people, so that its name links no
rows.

Defined results: null and blank names link nothing, but their identifiers do; rows that hold two names
belong to no pair; repeated rows with one id count once. The catch-all names of COLLECTIVE link nothing.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import identifiers as I
from ..functions.similarity import lcs_length
from ..session import cut, discard, spread
from .components import alternating_stars, shared_value_edges

SUFFIX, COMMON = 5, 40

# Transliteration of Greek and Cyrillic letters, groups first.
GREEK = {
    "ντζ": "j", "τζ": "j", "ντ": "d", "μπ": "b", "γκ": "g", "γγ": "ng", "ου": "u", "αυ": "av", "ευ": "ev", "αι": "e", "ει": "i", "οι": "i", "υι": "i", "τσ": "ts", "α": "a", "β": "v", "γ": "g", "δ": "d", "ε": "e", "ζ": "z",
    "η": "i", "θ": "th", "ι": "i", "κ": "k", "λ": "l", "μ": "m", "ν": "n", "ξ": "x", "ο": "o", "π": "p", "ρ": "r", "σ": "s", "ς": "s", "τ": "t", "υ": "y", "φ": "f", "χ": "ch", "ψ": "ps", "ω": "o",
}
CYRILLIC = {
    "дж": "j", "кс": "x", "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "e", "ж": "zh", "з": "z", "и": "i", "й": "i", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u",
    "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "iu", "я": "ia", "і": "i", "ї": "i", "є": "ie", "ґ": "g",
}
# Short forms of given names, folded, by the form they stand for.
NICKNAMES = {
    "robert": "bob bobby rob robbie bert", "thomas": "tom tommy", "frances": "fanny fran francie", "william": "bill billy will willy", "jose": "pepe", "gerard": "gege", "ursula": "uschi ulla", "friedrich": "fritz fred", "vincenzo": "enzo",
    "konstantinos": "kostas costas", "katherine": "kate kathy katie kitty kay", "salvatore": "toto turi", "elizabeth": "liz lizzie beth betty bess eliza", "margaret": "peggy meg maggie madge", "charles": "charlie chuck", "james": "jim jimmy jamie",
    "edward": "ed eddie ted teddy ned", "george": "georgie", "samuel": "sam sammy", "leonard": "leo len lenny", "peter": "pete", "nicolas": "nico nick", "helen": "nell nelly", "alice": "allie", "victoria": "vicky tori", "anna": "annie nan", "oliver": "ollie",
    "antoine": "toine tony", "veronique": "vero", "beatrice": "bea", "francois": "fanfan", "jean": "jeannot", "pierre": "pierrot", "marie": "manon", "isabelle": "isa zabou", "therese": "tess", "helene": "leni", "yvonne": "vonette", "xavier": "xav",
    "johannes": "hans", "wilhelm": "willi", "dieter": "didi", "matthias": "matze", "elisabeth": "lisbeth lili sissi", "kathe": "katharina", "renate": "reni", "heinrich": "heinz", "josef": "sepp", "margarete": "grete gretel",
    "francisco": "paco pancho curro", "ignacio": "nacho", "dolores": "lola", "mercedes": "merche", "francesca": "checca", "giuseppe": "beppe peppe peppino pino", "luigi": "gigi", "giovanni": "gianni nanni", "francesco": "ciccio cecco", "teresa": "tere",
    "rafael": "rafa", "antonio": "tonio toni", "concepcion": "concha", "pilar": "pili", "guadalupe": "lupe", "enrique": "quique", "manuel": "manolo", "jesus": "chus", "paolo": "paolino", "michele": "lino", "domenico": "mimmo",
    "mikhail": "misha", "aleksandr": "sasha sacha", "dmitri": "dima mitya", "vladimir": "volodia vova", "tatiana": "tania", "sergei": "serioja seryozha", "nikolai": "kolia kolya", "ekaterina": "katia", "maria": "masha", "irina": "ira", "olga": "olia", "pavel": "pasha", "galina": "galia", "anastasia": "nastia", "ivan": "vania", "lev": "liova", "boris": "boria",
    "dimitrios": "mitsos dimitris", "georgios": "giorgos yorgos", "ioannis": "giannis yannis", "nikolaos": "nikos", "panagiotis": "takis", "eleni": "lena", "theodoros": "thodoris", "petros": "petrakis", "ioanna": "gianna", "sofia": "sofi",
}
NICK = {short: long for long, shorts in NICKNAMES.items() for short in shorts.split()}
# Words that make a name that of an organisation, by their stems.
ORG_STEMS = (
    "acad", "univ", "soc", "socie", "mus", "museo", "museum", "musee", "centr", "institut", "inst", "seminar", "sem", "bibl", "archiv", "arch", "archeol", "etud", "et", "ecole", "facult", "fakult", "depart", "labor", "associa", "verein", "gesellsch", "comm", "comit",
    "civic", "civ", "antiq", "hist", "mediev", "citta", "ville", "stadt", "editor", "verlag", "press", "college", "school", "union", "found", "fond", "stift", "kommission", "zentrum", "instituto", "istituto",
)
ORG_SURE = re.compile(r"^(acad|univ|soc|mus|centr|instit|inst$|semin|bibl|archiv|ecole|facult|fakult|depart|labor|associa|verein|gesellsch|commis|comit|college|school|foundation|fondation|stiftung|kommission|zentrum)")
STOP = {"the", "of", "de", "des", "du", "d", "la", "le", "les", "der", "die", "das", "di", "del", "della", "dei", "and", "et", "und", "e", "y", "for", "fur", "pour", "in", "a", "l", "zu"}
PARTICLES = {"von", "van", "de", "du", "des", "del", "della", "di", "da", "der", "den", "la", "le", "zu", "zur", "ten", "ter", "dos", "d", "af", "av"}
ROLES = re.compile(r"(?i)(?<!\w)(éd|ed|eds|éds|edd|hrsg|hg|dir|trad|transl|coord|coll|ed\. by|edited by|sous la dir|prof|dr|pr|mr|mrs|mme|m\.lle|sir|jr|sr|phd|abbé|père|rev)(?:\.|(?!\w))(?: by)?")
COLLECTIVE = {"collectif", "anonyme", "anonymous", "collective", "divers", "various", "aavv", "vvaa", "autori vari", "et al"}


def plain(s: str) -> str:
    """Lower case, without marks, Greek and Cyrillic in Latin letters."""
    s = s.lower()
    if re.search(r"[Ͱ-Ͽἀ-῿]", s):
        s = "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c))
        s = re.sub("|".join(GREEK), lambda m: GREEK[m[0]], s)
    if re.search(r"[Ѐ-ӿ]", s):
        s = unicodedata.normalize("NFC", s)
        s = re.sub("|".join(CYRILLIC), lambda m: CYRILLIC[m[0]], s)
    s = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
    return s.translate(str.maketrans({"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "ł": "l", "đ": "d", "ı": "i"}))


def _words(s: str) -> list[str]:
    return re.findall(r"[^\W\d_]+", plain(s))


def _abbreviated(t: str) -> bool:
    """Whether at least two words stand for what organisations are called by, cut off by a stop or long enough."""
    short = {plain(w) for w in re.findall(r"(?<!\w)([^\W\d_]{2,})\.", t)}
    return sum(any(w.startswith(x) for x in ORG_STEMS if len(x) > 3 or w in short) for w in set(_words(t)) | short if w not in STOP or w in short) > 1


def parse(raw: str | None) -> tuple[str, list[str], list[str]]:
    """('', [], []) for nothing, 'two' for two names, 'org' with its type stems and its own words, 'person'
    with the family name's words and the given names, 'open' with all words where their order is unknown."""
    t = html.unescape(html.unescape(raw or ""))
    t = re.sub(r"&(#?\w{1,8});?", lambda m: html.unescape(f"&{m[1]};"), t).replace(" ", " ")
    if not t.strip() or plain(t).strip(" .") in I.SENTINELS:
        return "", [], []
    found = _words(t)
    if (any(ORG_SURE.match(w) for w in found) or _abbreviated(t)) and not (t.count(",") == 1 and len(found) == 2):
        kinds = sorted({s for w in found for s in [next((x for x in sorted(ORG_STEMS, key=len) if w.startswith(x)), None)] if s and w not in STOP})
        own = [w for w in found if w not in STOP and len(w) > 1 and not any(w.startswith(x) for x in ORG_STEMS)]
        return ("org", kinds, own) if own else ("", [], [])
    t = re.sub(r"\(?\b\d{3,4}\s*[-–.]+\s*(\d{3,4}|\.*)\)?|[\d*†]", " ", t)
    t = ROLES.sub(" ", t)
    t = re.sub(r"^[\s\[({]+|[\s\])}]+$", "", re.sub(r"\(\s*\)", "", t))
    t = re.sub(r"\s*,\s*(?=,|$)", "", t).strip(" ,;")
    sides = [x for x in re.split(r"\s*(?:[;&/]|\s(?:et|and|und|y|e|con|with)\s)\s*", t) if len(_words(x)) > 0]
    if len(sides) > 1:
        if all("," in x or len(_words(x)) > 1 for x in sides):
            return "two", [], []
        t = re.sub(r"[;&/]", ",", t)
    if m := re.match(r"^([^(),]+)\(([^()]+)\)$", t):
        t = f"{m[1]}, {m[2]}"
    if " ".join(_words(t)) in COLLECTIVE:
        return "", [], []
    if "," in t:
        family, _, given = t.partition(",")
        family, given = _words(family), _words(given)
        family = [w for w in family if w not in PARTICLES] or family
        given = [w for w in given if w not in PARTICLES]
        if not family:
            return ("open", given, []) if given else ("", [], [])
        return "person", family, given
    w = [x for x in _words(t) if x not in PARTICLES]
    return ("open", w, []) if w else ("", [], [])


def _typo(a: str, b: str) -> bool:
    """Whether the ratio of the longest common subsequence to the longer word is that of one letter, of two in
    long words, gone wrong."""
    n = max(len(a), len(b))
    return n > 3 and lcs_length(a, b) / n >= 1 - (1 if n < 9 else 2) / n - 1e-9


def given_like(a: list[str], b: list[str], known: set[str]) -> str:
    """'full', 'initial' or ''. known: given names that are common, so that one isn't a misspelling of another."""
    if not a or not b:
        return ""
    full = lambda g: any(len(w) > 1 for w in g)
    if not full(a) or not full(b):
        x, y = [w[0] for w in a], [w[0] for w in b]
        small = min(len(x), len(y))
        if x[:small] != y[:small]:
            return ""
        return "full" if not full(a) and not full(b) else "initial"
    # a second name that one side gives as a letter, or not at all
    x, y = [w for w in a if len(w) > 1], [w for w in b if len(w) > 1]
    if a[0] != x[0] or b[0] != y[0]:
        if len(a) == len(b) and all(p[0] == q[0] for p, q in zip(a, b)):
            return "initial"
    if len(x) != len(y):
        return ""
    for p, q in zip(x, y):
        p2, q2 = NICK.get(p, p), NICK.get(q, q)
        if p != q and p2 != q2 and not (_typo(p, q) and not (p in known and q in known)):
            return ""
    return "full"


def family_like(a: list[str], b: list[str]) -> bool:
    x, y = "".join(a), "".join(b)
    return x == y or (min(len(x), len(y)) > 3 and _typo(x, y))


def _orders(kind: str, first: list[str], rest: list[str]) -> list[tuple[list[str], list[str]]]:
    if kind == "person":
        return [(first, rest)] + ([(rest, first)] if len(rest) == 1 and len(first) == 1 and len(rest[0]) > 1 else [])
    return [(first[-1:], first[:-1]), (first[:1], first[1:])]


def alike(a: tuple, b: tuple, known: set[str]) -> str:
    """'full', 'initial' or ''. Each side: kind, words, words, as parse() gives them."""
    if "org" in (a[0], b[0]):
        if a[0] != b[0]:
            return ""
        x, y = sorted((a[2], b[2]), key=len)
        own = all(any(w == v or _typo(w, v) for v in y) for w in x) and len(y) - len(x) <= 1
        kinds = set(a[1]) <= set(b[1]) or set(b[1]) <= set(a[1]) or all(any(p.startswith(q) or q.startswith(p) for q in b[1]) for p in a[1]) or all(any(p.startswith(q) or q.startswith(p) for q in a[1]) for p in b[1])
        return "full" if own and kinds else ""
    best = ""
    for fa, ga in _orders(*a):
        for fb, gb in _orders(*b):
            if fa and fb and len("".join(fa)) > 1 and len("".join(fb)) > 1 and family_like(fa, fb):
                g = given_like(ga, gb, known)
                if g == "full":
                    return g
                best = best or g
    return best


def _keys(kind: str, first: list[str], rest: list[str]) -> list[tuple[str, str, str, str, str]]:
    """Index keys of a form: suffix, two refinements of it, and the two names that the last step takes."""
    out = set()
    if kind == "org":
        for w in rest:
            for i in range(max(1, len(w) - SUFFIX + 1)):
                s = w[i:]
                out |= {(s, f"{s}|{w[:2]}", f"{s}|{w[:4]}", w, k[:2]) for k in first or [""]}
        return list(out)
    for family, given in _orders(kind, first, rest):
        f, g = "".join(family), given[0] if given else ""
        if len(f) < 2:
            continue
        for i in range(max(1, len(f) - SUFFIX + 1)):
            s = f[i:]
            out |= {(s, f"{s}|{g[:1]}", f"{s}|{g[:1]}|{f[:2]}", f, w) for w in (g, NICK.get(g, g))}
        for w in {g, NICK.get(g, g)}:
            if len(w) > 1:
                for i in range(max(1, len(w) - SUFFIX + 1)):
                    s = w[i:]
                    out.add((s, f"{s}|{f[:3]}", f"{s}|{f[:3]}|{w[:1]}", f, w))
    return list(out)


def _families(kind, first, rest):
    """What a form's family name may be; the words of an organisation."""
    whole, only = F.array_join(first, ""), F.get(rest, F.lit(0))
    person = F.when((F.size(rest) == 1) & (F.size(first) == 1) & (F.length(only) > 1), F.array(whole, only)).otherwise(F.array(whole))
    return F.when(kind == "org", rest).otherwise(F.filter(F.when(kind == "person", person).otherwise(F.array(F.try_element_at(first, F.lit(-1)), F.get(first, F.lit(0)))), lambda w: F.length(w) > 1))


def _near(w):
    """A word, and what is left of it without one letter, from nine letters on without two."""
    def less(c):
        return F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), c.substr(i + 1, F.length(c))))

    one = F.when(F.length(w) > 3, less(w)).otherwise(F.array().cast("array<string>"))
    two = F.when(F.length(w) > 8, F.flatten(F.transform(one, less))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(w), one, two))


def hot_pairs(d: DataFrame, common: int = COMMON) -> list[DataFrame]:
    """(p, q) of forms under common keys: of one family and given names alike and of families alike and one given
    name, of a family that few forms have and one alike with the same letter, and of initials with whom they may
    stand for. d: form, f, g."""
    key = lambda x, y: F.concat_ws("|", x, y)
    keys = F.concat(F.transform(_near(F.col("f")), lambda x: key(x, F.col("g"))), F.transform(_near(F.col("g")), lambda y: key(F.col("f"), y)))
    k = d.select("form", F.explode(F.array_distinct(keys)).alias("key")).distinct()
    edits = k.select("key", F.col("form").alias("p")).join(k.select("key", F.col("form").alias("q")), "key").where("p < q").select("p", "q")
    letter = d.select("form", "f", F.substring("g", 1, 1).alias("i"), (F.length("g") < 2).alias("short"))
    few = letter.groupBy("f", "i").agg(F.count_distinct("form").alias("n")).where(F.col("n") <= common).select("f", "i")
    near = letter.select("form", "f", "i", F.explode(_near(F.col("f"))).alias("x")).distinct()
    rare = near.join(few, ["f", "i"], "left_semi").select("x", "i", F.col("form").alias("p")).join(near.select("x", "i", F.col("form").alias("q")), ["x", "i"]).select("p", "q")
    # there are few forms of initials to a family name
    initials = letter.where("short").select("f", "i", F.col("form").alias("p")).join(letter.select("f", "i", F.col("form").alias("q")), ["f", "i"]).select("p", "q")
    return [edits, rare, initials]


FORM = "kind string, first array<string>, rest array<string>"


def forms(authors: DataFrame) -> DataFrame:
    """(id, kind, first, rest, form) of every row; form is a hash, null where there is no name."""
    def run(batches: Iterator) -> Iterator:
        for b in batches:
            p = [parse(n) for n in b["NomComplet"]]
            yield b[["id"]].assign(kind=[x[0] for x in p], first=[x[1] for x in p], rest=[x[2] for x in p])

    d = spread(authors.where("id IS NOT NULL").select(F.col("id").cast("bigint").alias("id"), "NomComplet")).mapInPandas(run, f"id bigint, {FORM}")
    return d.withColumn("form", F.when(~F.col("kind").isin("", "two"), F.xxhash64("kind", F.array_join("first", " "), F.array_join("rest", " "))))


def similar_forms(distinct: DataFrame, common: int = COMMON) -> DataFrame:
    """(a, b, how) of forms that may name one person. distinct: form, kind, first, rest."""
    def emit(batches: Iterator) -> Iterator:
        import pandas as pd

        for b in batches:
            rows = [(f, *k) for f, kind, first, rest in zip(b["form"], b["kind"], b["first"], b["rest"]) for k in _keys(kind, list(first), list(rest))]
            yield pd.DataFrame(rows, columns=["form", "k0", "k1", "k2", "f", "g"])

    # a key is only compared with itself: its hash is enough, and short on disk; what meets by chance is compared
    levels = ("k0", "k1", "k2")
    left = cut(distinct.mapInPandas(emit, "form bigint, k0 string, k1 string, k2 string, f string, g string").select("form", *[F.xxhash64(F.lit(k), k).alias(k) for k in levels], "f", "g"))
    taken = []
    for i, level in enumerate(levels):
        n = left.select(level, "form").distinct().groupBy(level).agg((F.count("*") <= common).alias("ok"))
        judged = left.join(n, level)
        taken.append(cut(judged.where("ok").select("form", F.col(level).alias("key")).distinct()))
        older, left = left, cut(judged.where("NOT ok").select("form", *levels[i + 1 :], "f", "g").distinct())
        discard(older)
    # each kind of meeting is a run of its own, whose files are deleted before the next: together they take several times the disk
    fam = distinct.select("form", (F.col("kind") == "org").alias("org"), _families(F.col("kind"), F.col("first"), F.col("rest")).alias("fam"))
    # no ratio can be reached where Levenshtein's distance is beyond twice the letters that may be wrong
    may = lambda u, v: (u == v) | ((F.least(F.length(u), F.length(v)) > 2) & (F.call_function("levenshtein", u, v, F.when(F.greatest(F.length(u), F.length(v)) < 9, 2).otherwise(4)) >= 0))

    def likely(met: DataFrame) -> DataFrame:
        pairs = met.where("p <> q").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()
        pairs = pairs.join(fam.select(F.col("form").alias("a"), F.col("org").alias("ox"), F.col("fam").alias("fx")), "a").join(fam.select(F.col("form").alias("b"), F.col("org").alias("oy"), F.col("fam").alias("fy")), "b")
        return cut(pairs.where(F.col("ox") == F.col("oy")).where(F.exists("fx", lambda u: F.exists("fy", lambda v: may(u, v)))).select("a", "b"))

    found = []
    for t in taken:
        found.append(likely(t.select("key", F.col("form").alias("p")).join(t.select("key", F.col("form").alias("q")), "key").where("p < q").select("p", "q")))
        discard(t)
    found += [likely(met) for met in hot_pairs(left, common)]
    discard(left)
    pairs = reduce(DataFrame.unionAll, found).distinct()
    # given names that are common aren't misspellings of each other: their counts come with the forms
    given = distinct.select("form", F.when(F.col("kind") == "person", F.try_element_at("rest", F.lit(1))).alias("g"))
    total = distinct.count()
    often = given.where("g IS NOT NULL").groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") >= 3 + total * 2e-4).select("g")
    words = distinct.select("form", F.explode(F.concat("first", "rest")).alias("g")).join(often, "g", "left_semi").groupBy("form").agg(F.collect_set("g").alias("known"))
    side = distinct.join(words, "form", "left").select("form", F.struct("kind", "first", "rest", "known").alias("s"))
    both = pairs.join(side.select(F.col("form").alias("a"), F.col("s").alias("x")), "a").join(side.select(F.col("form").alias("b"), F.col("s").alias("y")), "b")

    def compare(batches: Iterator) -> Iterator:
        for b in batches:
            how = []
            for x, y in zip(b["x"], b["y"]):
                known = set(x["known"] if x["known"] is not None else ()) | set(y["known"] if y["known"] is not None else ())
                how.append(alike((x["kind"], list(x["first"]), list(x["rest"])), (y["kind"], list(y["first"]), list(y["rest"])), known))
            yield b[["a", "b"]].assign(how=how)[[bool(h) for h in how]]

    out = cut(both.mapInPandas(compare, "a bigint, b bigint, how string"))
    discard(*found)
    return out


def name_clusters(distinct: DataFrame) -> DataFrame:
    """(form, cluster): forms that name one person as far as names tell."""
    edges = similar_forms(distinct)
    letters = lambda c: F.size(F.filter(c, lambda w: F.length(w) == 1))
    short = F.when(F.col("kind") == "person", (F.size("rest") > 0) & (letters("rest") == F.size("rest"))).otherwise((F.col("kind") == "open") & (F.size("first") > 1) & (letters("first") == F.size("first") - 1))
    full = alternating_stars(edges.where("how = 'full'").select("a", "b"))
    at = cut(distinct.select("form", short.alias("short")).join(full.select(F.col("id").alias("form"), "group_id"), "form", "left").select("form", F.coalesce("group_id", "form").alias("cluster"), "short"))
    weak = edges.where("how = 'initial'").select("a", "b").unionAll(edges.where("how = 'initial'").select(F.col("b").alias("a"), F.col("a").alias("b")))
    into = weak.join(at.select(F.col("form").alias("a"), F.col("cluster").alias("ca")), "a").join(at.select(F.col("form").alias("b"), F.col("cluster").alias("cb")), "b").where("ca <> cb")
    shorts = at.groupBy("cluster").agg(F.min("short").alias("short"))
    into = into.join(shorts.where("short").select(F.col("cluster").alias("ca")), "ca", "left_semi").join(shorts.where("NOT short").select(F.col("cluster").alias("cb")), "cb", "left_semi")
    fits = into.groupBy("ca").agg(F.count_distinct("cb").alias("n"), F.min("cb").alias("cb"))
    return at.join(fits.withColumnRenamed("ca", "cluster"), "cluster", "left").select("form", F.when(F.col("n") == 1, F.col("cb")).when(F.col("n") > 1, None).otherwise(F.col("cluster")).alias("cluster"))


def people(authors: DataFrame) -> DataFrame:
    """(id, group_id) of every row that names the same person or organisation as another one."""
    named = cut(forms(authors))
    kinds = {"ppn": I.ppn(F.col("PPN_IDREF")), "viaf": I.viaf(F.col("PPN_VIAF")), "orcid": I.orcid(F.col("orcid")), "isni": I.isni(F.col("isni"))}
    values = authors.where("id IS NOT NULL").select(F.col("id").cast("bigint").alias("id"), F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in kinds.items()])).alias("v")).select("id", "v.kind", "v.value").where("value IS NOT NULL")
    values = cut(values.join(named.where("kind = 'two'").select("id"), "id", "left_anti").distinct())
    chain_edges = shared_value_edges(values)
    chains = alternating_stars(chain_edges)
    held = values.select("id").distinct().join(chains, "id", "left").select("id", F.coalesce("group_id", "id").alias("chain"))
    held = cut(held)
    of_chain = values.join(held, "id").groupBy("chain").agg(F.collect_set("kind").alias("kinds"))
    distinct = cut(named.where("form IS NOT NULL").dropDuplicates(["form"]).select("form", "kind", "first", "rest"))
    clusters = cut(name_clusters(distinct))
    discard(distinct)
    rows = cut(named.where("form IS NOT NULL").select("id", "form").join(clusters.where("cluster IS NOT NULL"), "form").join(held, "id", "left").select("id", "cluster", "chain"))
    # a kind of identifier that two chains of a cluster have: several people under one name
    several = rows.where("chain IS NOT NULL").select("cluster", "chain").distinct().join(of_chain, "chain").select("cluster", F.explode("kinds").alias("kind")).groupBy("cluster", "kind").agg(F.count("*").alias("n")).where("n > 1").select("cluster").distinct()
    clear = rows.join(several, "cluster", "left_anti")
    hub = clear.groupBy("cluster").agg(F.min("id").alias("hub"))
    name_edges = clear.join(hub, "cluster").where("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b"))
    return alternating_stars(chain_edges.select("a", "b").unionAll(name_edges))


def groups(authors: DataFrame) -> DataFrame:
    """(id, group_id, links) of every row of `people`: its person and the number of other rows it is linked to."""
    g = people(authors)
    return g.join(g.groupBy("group_id").agg((F.count("*") - 1).alias("links")), "group_id").select("id", "group_id", "links")


def pairs(grouped: DataFrame) -> DataFrame:
    """(id_a, id_b): all pairs of rows of one person, as the problem's statement wants them."""
    return grouped.select("group_id", F.col("id").alias("id_a")).join(grouped.select("group_id", F.col("id").alias("id_b")), "group_id").where("id_a < id_b").select("id_a", "id_b")
