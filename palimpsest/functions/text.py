"""Normalisers, extractors and clean-ups of text fields.

Every function takes and gives columns, and all but those that strip marks, decode entities or
transliterate stay inside the JVM. Nulls give nulls unless a docstring says otherwise; matching is
Unicode-aware.
"""

from __future__ import annotations

import html
import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Dashes and quotes that are written as one, for keyword-in-context.
DASHES, QUOTES = "–—‒‑", "’‘"
# Dashes a broken word may end with.
HYPHENS = "-‐‑‒–—⁃"
# Number words by value, unaccented, in French, English, German, Spanish; the compounds are
# written with a hyphen.
NUMBER_WORDS = {
    1: "UN UNE ONE EIN EINE UNO UNA", 2: "DEUX TWO ZWEI DOS", 3: "TROIS THREE DREI TRES", 4: "QUATRE FOUR VIER CUATRO", 5: "CINQ FIVE FUNF CINCO", 6: "SIX SECHS SEIS", 7: "SEPT SEVEN SIEBEN SIETE", 8: "HUIT EIGHT ACHT OCHO",
    9: "NEUF NINE NEUN NUEVE", 10: "DIX TEN ZEHN DIEZ", 11: "ONZE ELEVEN", 12: "DOUZE TWELVE", 13: "TREIZE THIRTEEN", 14: "QUATORZE FOURTEEN", 15: "QUINZE FIFTEEN", 16: "SEIZE SIXTEEN", 17: "DIX-SEPT SEVENTEEN", 18: "DIX-HUIT EIGHTEEN", 19: "DIX-NEUF NINETEEN",
    20: "VINGT TWENTY", 21: "VINGT-ET-UN TWENTY-ONE", 22: "VINGT-DEUX TWENTY-TWO", 23: "VINGT-TROIS TWENTY-THREE", 24: "VINGT-QUATRE TWENTY-FOUR", 25: "VINGT-CINQ TWENTY-FIVE",
}
# Words for parts of a work.
CHAPTER_WORDS = "CHAPITRE CHAPTER PART PARTIE TEIL CAPITULO TOME VOLUME".split()
APPARATUS_WORDS = "INTRO INTRODUCTION PREFACE PROLOGUE EPILOGUE ABBREVIATION CONCLUSION INDEX APPENDIX".split()
# Titles that say nothing about a text.
GENERIC_TITLES = (
    "introduction", "conclusion", "preface", "foreword", "afterword", "epilogue", "prologue", "bibliography", "index", "appendix", "abstract", "summary", "acknowledgements", "acknowledgments", "avant propos", "note", "notes",
    "postface", "postscript", "contents", "table of contents", "list of figures", "list of tables",
)
GENERIC_FOR_LANGUAGE = ("introduction", "conclusion", "abstract", "preface", "foreword", "index", "bibliography", "references", "contents", "acknowledgments", "avant-propos", "résumé")
# Language codes that are kept, and names for some of them.
LANGUAGES = "en fr de it es pt nl pl ru ar zh ja tr el cs ro hu sv no da fi uk ca hr sk bg lt sl et lv ko vi th id".split()
LANGUAGE_NAMES = {"english": "en", "french": "fr", "german": "de", "spanish": "es", "italian": "it", "arabic": "ar", "chinese": "zh", "russian": "ru", "turkish": "tr"}
# Ordinals after which a hyphen is genuine.
ORDINALS = "first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth thirteenth fourteenth fifteenth sixteenth seventeenth eighteenth nineteenth twentieth".split()
# Blocks of scripts, in order of precedence.
SCRIPTS = (("ru", "\\u0400-\\u04FF"), ("el", "\\u0370-\\u03FF"), ("hy", "\\u0530-\\u058F"), ("ka", "\\u10A0-\\u10FF"), ("ar", "\\u0600-\\u06FF"), ("he", "\\u0590-\\u05FF"))
# Letters of these scripts in Latin, one for one or for several.
TO_LATIN = {
    "ru": ("абвгдежзийклмнопрстуфхцчшщъыьэюя", "a b v g d e zh z i i k l m n o p r s t u f kh ts ch sh shch - y - e iu ia"),
    "el": ("αβγδεζηθικλμνξοπρσςτυφχψω", "a v g d e z i th i k l m n x o p r s s t y f ch ps o"),
    "hy": ("աբգդեզէըթժիլխծկհձղճմյնշոչպջռսվտրցւփքօֆև", "a b g d e z e y t zh i l kh ts k h dz gh ch m y n sh o ch p j r s v t r ts v p k o f ev"),
    "ka": ("აბგდევზთიკლმნოპჟრსტუფქღყშჩცძწჭხჯჰ", "a b g d e v z t i k l m n o p zh r s t u p k gh q sh ch ts dz ts ch kh j h"),
    "ar": ("ابتثجحخدذرزسشصضطظعغفقكلمنهويةىءأإآ", "a b t th j h kh d dh r z s sh s d t z - gh f q k l m n h w y a a - a i a"),
    "he": ("אבגדהוזחטיכךלמםנןסעפףצץקרשת", "a b g d h v z kh t y k k l m m n n s a p p ts ts q r sh t"),
}

ROMAN_VALUES = {"I": 1, "V": 5, "X": 10}


def roman(n: int) -> str:
    """n up to 39 in Roman numerals."""
    return "X" * (n // 10) + ["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"][n % 10]


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def _mark_stripper(form: str):
    @F.pandas_udf("string")
    def strip(s):
        import pandas as pd

        return pd.Series([None if x is None else "".join(c for c in unicodedata.normalize(form, x) if unicodedata.category(c) != "Mn") for x in s], dtype=object)

    return strip


def strip_marks(c: Column, form: str = "NFD") -> Column:
    return _mark_stripper(form)(c)


def entities(c: Column, repair: bool = False) -> Column:
    """HTML entities decoded; with repair, numeric ones that lost their semicolon too, then composed (NFC)."""
    @F.pandas_udf("string")
    def decode(s):
        import pandas as pd

        def one(x):
            if x is None:
                return None
            return unicodedata.normalize("NFC", html.unescape(re.sub(r"&#(\d+|x[0-9a-fA-F]+)(?![\d;a-fA-F])", r"&#\1;", x))) if repair else html.unescape(x)

        return pd.Series([one(x) for x in s], dtype=object)

    return decode(c)


def _no_punctuation(c: Column) -> Column:
    return collapse(F.regexp_replace(c, r"(?U)[^\w\s]", " "))


def name_key(c: Column) -> Column:
    """Lower case without marks and punctuation; digits and underscores stay."""
    return _no_punctuation(strip_marks(F.lower(c)))


def reference_key(c: Column) -> Column:
    """As name_key, after compatibility decomposition."""
    return _no_punctuation(F.lower(strip_marks(c, "NFKD")))


def ascii_key(c: Column) -> Column:
    """As reference_key, with what isn't ASCII dropped before the punctuation goes."""
    return _no_punctuation(F.lower(F.regexp_replace(strip_marks(c, "NFKD"), r"[^\x00-\x7F]", "")))


def strict_ascii_key(c: Column) -> Column:
    """Lower-case ASCII letters and digits, anything else a space."""
    return collapse(F.regexp_replace(F.regexp_replace(strip_marks(F.lower(c), "NFKD"), r"[^\x00-\x7F]", ""), r"[^a-z0-9\s]", " "))


def accented_key(c: Column) -> Column:
    """Lower case without punctuation; accents stay. Native."""
    return _no_punctuation(F.lower(c))


def aggressive_key(c: Column) -> Column:
    """Sentinels to empty, tags and entities to spaces, then an ASCII key."""
    t = F.regexp_replace(F.regexp_replace(c, r"(?i)</?(?:i|b|em|strong|sup|sub|span|p|br|scp|jats:[a-z]+|xhtml:[a-z]+)\b[^>]*>", " "), r"&(?:[a-zA-Z]{2,8}|#\d+);", " ")
    return F.when(c.isNull() | (F.trim(c).isin("", "NA")), "").otherwise(ascii_key(t))


def clean_markup(c: Column) -> Column:
    """Entities decoded, inline tags dropped, doubled apostrophes single; texts that hold neither stay as they are."""
    tags = r"(?i)</?(?:b|i|sup|em|br|bold|span|xhtml:span)\b[^>]*>"
    clean = collapse(F.regexp_replace(F.regexp_replace(entities(c), tags, ""), "''+", "'"))
    return F.when(c.rlike(tags) | c.contains("&"), clean).otherwise(c)


def context_key(c: Column) -> Column:
    """One dash, one quote, lower case. Native."""
    return F.lower(F.translate(c, DASHES + QUOTES, "-" * len(DASHES) + "'" * len(QUOTES)))


def folded(c: Column) -> Column:
    return F.lower(collapse(c))


def one_line(c: Column) -> Column:
    """Line breaks and tabs to spaces; null to an empty string."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\r\n\t]+", " "))


def doi_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), r"^(?:https?://(?:dx\.)?doi\.org/|doi:)\s*", "")


def issn_key(c: Column) -> Column:
    """First of a list, digits and X only; empty if shorter than seven."""
    k = F.upper(F.regexp_replace(F.element_at(F.split(c, "[;,]"), 1), "[^0-9Xx]", ""))
    return F.when(F.length(k) < 7, "").otherwise(k)


def id_key(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"[\s\-]", ""))


DOI = r"10\.\d{4,}/[\w.();:/\-]+"


def extract_doi(c: Column) -> Column:
    """The first DOI in a text; null if there is none."""
    d = F.regexp_extract(c, f"({DOI})", 1)
    return F.when(d != "", d)


def without_doi(c: Column) -> Column:
    """The text without DOIs, their prefixes and URLs, and what these leave at its end."""
    t = F.regexp_replace(c, rf"(?i)<?\s*https?://[^\s>]*/doi/{DOI[:-2]}>]+", "")
    t = F.regexp_replace(t, rf"(?i)(?:info:doi/|<?\s*https?://[^\s>]*/doi/|[-–,\s]*\bdoi\s*:\s*|In:\s+)?{DOI}", "")
    return collapse(F.regexp_replace(F.trim(F.regexp_replace(t, r"\s*[-–]+\s*$", "")), r"\bIn:\s*$", ""))


def author_name(c: Column) -> Column:
    """struct(name, orcid): parentheses around the whole and asterisks dropped, an ORCID link cut off."""
    t = F.trim(F.regexp_replace(F.regexp_replace(c, r"^\s*\((.*)\)\s*$", "$1"), r"\*", ""))
    orcid = F.regexp_extract(t, r";\s*https?://orcid\.org/([0-9Xx-]+)", 1)
    return F.struct(F.trim(F.regexp_replace(t, r";\s*https?://orcid\.org/.*$", "")).alias("name"), F.when(orcid != "", orcid).alias("orcid"))


def name_parts(c: Column) -> Column:
    """struct(family, given) around the first comma."""
    p = F.split(c, ",", 2)
    strip = lambda x: F.regexp_replace(x, r"^[\s,*]+|[\s,*]+$", "")
    return F.struct(strip(F.get(p, F.lit(0))).alias("family"), strip(F.coalesce(F.get(p, F.lit(1)), F.lit(""))).alias("given"))


def split_names(c: Column) -> Column:
    """Names joined by an ampersand, those of one letter dropped."""
    return F.filter(F.transform(F.split(F.regexp_replace(c, "&amp;", "&"), "&"), lambda x: F.trim(x)), lambda x: F.length(x) > 1)


def clean_title(c: Column) -> Column:
    """Leading dot, colon or bracket dropped, the bracket's partner too; null gives an empty string."""
    t = F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"^\.(?:\s+|(?=\p{L}))", "")
    t = F.trim(F.regexp_replace(F.trim(t), "^:", ""))
    return F.trim(F.when(t.startswith("["), F.regexp_replace(F.regexp_replace(t, r"^\[\s*", ""), r"^([^\]]*)\]", "$1")).otherwise(t))


def full_signature(key: Column) -> Column:
    return F.array_join(F.array_sort(F.split(key, " ")), " ")


def minimal_signature(key: Column) -> Column:
    """Sorted words of more than one letter; all words where there is none."""
    m = F.array_join(F.array_sort(F.filter(F.split(key, " "), lambda w: F.length(w) > 1)), " ")
    return F.when(m == "", full_signature(key)).otherwise(m)


def initial_match(a: Column, b: Column) -> Column:
    """One given name, shorter than three characters, begins the other."""
    return ((F.length(a) < 3) & (F.length(a) > 0) & b.startswith(a)) | ((F.length(b) < 3) & (F.length(b) > 0) & a.startswith(b))


def script(c: Column) -> Column:
    """Code of the non-Latin script with the most characters; null if there are none."""
    n = {code: F.length(F.regexp_replace(c, f"[^{block}]", "")) for code, block in SCRIPTS}
    top = F.greatest(*n.values())
    return F.coalesce(*[F.when((n[code] == top) & (top > 0), code) for code, _ in SCRIPTS])


def to_latin(c: Column) -> Column:
    """Lower-case text with letters of other scripts in Latin ones."""
    singles, several = "", []
    into = ""
    for chars, latin in TO_LATIN.values():
        for a, b in zip(chars, latin.split()):
            if len(b) == 1 and b != "-":
                singles, into = singles + a, into + b
            else:
                several.append((a, "" if b == "-" else b))
    t = F.translate(F.lower(c), singles, into)
    for a, b in several:
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def chapter_number(ascii_title: Column) -> Column:
    """Number from 1 to 25 that a title of a chapter holds, by keyword, digits, Roman numeral or word.
    ascii_title: as ascii_key gives it."""
    s = F.upper(ascii_title)
    romans = "|".join(sorted((roman(n) for n in range(1, 26)), key=len, reverse=True))
    pick = lambda p: F.nullif(F.regexp_extract(s, p, 1), F.lit(""))
    digits = [pick(rf"(?:{'|'.join(CHAPTER_WORDS)})\s*(\d+)"), pick(r"^\s*(\d+)[\s.:]"), pick(r"[\s(](\d+)[\s.:)]")]
    numerals = [pick(rf"^({romans})[\s.:]"), pick(rf"[\s(]({romans})[\s.:)]")]
    number = lambda d: F.when(d.try_cast("int").between(1, 25), d.try_cast("int"))
    value = F.create_map(*[x for n in range(1, 26) for x in (F.lit(roman(n)), F.lit(n))])
    word = F.coalesce(*[F.when(s.rlike(rf"\b(?:{w.replace(' ', '|')})\b"), n) for n, w in NUMBER_WORDS.items()])
    return F.coalesce(*[number(d) for d in digits], *[value[r] for r in numerals], word)


def without_chapter(ascii_title: Column) -> Column:
    """The title's words without those of chapters, apparatus and numbers up to 25."""
    drop = {*CHAPTER_WORDS, *APPARATUS_WORDS, *(roman(n) for n in range(1, 26)), *(x for w in NUMBER_WORDS.values() for x in w.split()), *map(str, range(1, 26))}
    return F.array_join(F.filter(F.split(F.upper(ascii_title), " "), lambda w: ~w.isin(*sorted(drop))), " ")


def word_set(key: Column, least: int = 3) -> Column:
    return F.array_distinct(F.filter(F.split(key, " "), lambda w: F.length(w) >= least))


def works(titles: Column, least: int = 5) -> Column:
    """Titles before the responsibility mark, distinct in order, short ones dropped."""
    return F.array_distinct(F.filter(F.transform(titles, lambda t: F.trim(F.split_part(t, F.lit(" / "), F.lit(1)))), lambda t: F.length(t) >= least))


def authority_id(kind: str, c: Column) -> Column:
    """An identifier as its authority writes it; kind: viaf, isni or bnf."""
    t = F.trim(c)
    if kind == "viaf":
        return F.regexp_replace(F.regexp_replace(t, "^http://viaf.org/viaf/", ""), "^/+|/+$", "")
    if kind == "isni":
        d = F.replace(t, F.lit(" "), F.lit(""))
        return F.when(F.length(d) == 16, F.concat_ws(" ", *[F.substring(d, i, 4) for i in (1, 5, 9, 13)])).otherwise(t)
    return F.regexp_replace(F.element_at(F.split(t, "/"), -1), "(?i)^cb", "")


def language_code(c: Column, names: bool = True) -> Column:
    """Two-letter code of a language tag or name; null for others."""
    k = F.split_part(F.split_part(F.lower(F.trim(c)), F.lit("-"), F.lit(1)), F.lit("_"), F.lit(1))
    if names:
        known = F.create_map(*[F.lit(x) for pair in LANGUAGE_NAMES.items() for x in pair])
        k = F.coalesce(known[k], k)
    return F.when(k.isin(*LANGUAGES), k)


def html_language(c: Column) -> Column:
    """Language a page declares: DC.language, citation_language, language, then the html tag."""
    def meta(names: str) -> list[Column]:
        return [F.nullif(F.regexp_extract(c, p, 1), F.lit("")) for p in (rf"(?i)<meta[^>]*name=[\"'](?:{names})[\"'][^>]*content=[\"']([^\"']+)[\"']", rf"(?i)<meta[^>]*content=[\"']([^\"']+)[\"'][^>]*name=[\"'](?:{names})[\"']")]

    return F.coalesce(*meta(r"DC\.language"), *meta("citation_language"), *meta("language|lang"), F.nullif(F.regexp_extract(c, r"(?i)<html[^>]*\blang=[\"']([^\"']+)[\"']", 1), F.lit("")))


def html_text(c: Column) -> Column:
    return collapse(F.regexp_replace(c, "<[^>]+>", " "))


def first_page(c: Column) -> Column:
    return F.trim(F.element_at(F.split(c, "[-–]"), 1))


def full_name(whole: Column, family: Column, given: Column) -> Column:
    n = lambda x: F.nullif(F.trim(x), F.lit(""))
    return F.coalesce(n(whole), F.when(n(family).isNotNull() & n(given).isNotNull(), F.concat_ws(", ", n(family), n(given))), n(family))


def usable_name(c: Column) -> Column:
    """A full given name is there: after a comma, or as one of two full words."""
    t = F.trim(F.coalesce(c, F.lit("")))
    full = lambda x: F.size(F.filter(F.split(x, r"[\s,]+"), lambda w: (w != "") & ~F.regexp_replace(w, r"\.+$", "").rlike(r"^\p{L}{1,2}$")))
    return F.when(t.contains(","), full(F.regexp_replace(t, "^[^,]*,", "")) >= 1).otherwise(full(t) >= 2)


def stem(c: Column) -> Column:
    """A token without the hyphen that ends it."""
    return F.regexp_replace(c, f"(?<=.)[{HYPHENS}]$", "")


def broken(c: Column) -> Column:
    return c.rlike(f"^.+[{HYPHENS}]$")


def next_word(c: Column) -> Column:
    return c.rlike("^[a-zA-ZÀ-ÿ]")


def genuine_hyphen(stem_: Column, after: Column) -> Column:
    """Compounds whose hyphen stays: numerals in -eenth, anglo-, ordinals before an ordinal or century."""
    s, t = F.lower(stem_), F.lower(after)
    return s.endswith("eenth") | (s == "anglo") | (s.isin(*ORDINALS) & t.isin(*ORDINALS, "century"))


def merge_text(text: Column, merges: Column) -> Column:
    """text with every merge applied in order; merges: array of struct(t1, t2, merged)."""
    quote = lambda x: F.concat(F.lit(r"\Q"), x, F.lit(r"\E"))
    return F.aggregate(merges, text, lambda acc, m: F.regexp_replace(acc, F.concat(quote(m["t1"]), F.lit(r"\s*"), quote(m["t2"])), F.regexp_replace(m["merged"], r"([\\$])", r"\\$1")))


def excluded(c: Column, segments: Column) -> Column:
    """The first category whose segment the normalised text contains; segments: array of struct(segment, category)."""
    hit = F.filter(segments, lambda s: F.contains(folded(c), s["segment"]))
    return F.get(hit, F.lit(0))["category"]


def variable(c: Column, length: int = 50) -> Column:
    return F.substring(F.replace(c, F.lit(" "), F.lit("_")), 1, length)


def tail(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)
