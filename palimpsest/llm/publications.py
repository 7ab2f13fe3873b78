"""Titles, hosts and years of publications in comparable form (problems 3 and 7)."""

from __future__ import annotations

import html
import re
import unicodedata

from ..functions.similarity import indel_ratio, osa

# Remarks of cataloguers, folded, that aren't part of a title.
DEBRIS = (
    "texte imprime", "texte electronique", "ressource electronique", "printed text", "electronic resource", "hrsg vom verein", "hrsg von", "dir coll", "sous la direction de", "actes du colloque",
    "tire a part", "tire part", "with plates", "avec planches", "mit tafeln", "2e ed", "3e ed", "nouv ed", "nouvelle edition", "rev ed", "2nd ed", "3rd ed", "2 aufl", "ill", "offprint", "estratto", "sonderdruck",
)
# Openings and ends that make a title that of a review.
REVIEWS = (
    r"^(compte rendu|comptes rendus|cr|review|book review|rezension|besprechung|recensione|resena|recension)( de| of| zu| von| di)?( l ouvrage)? (?=\w+ \w+)",
    r" (book review|review|compte rendu|rezension|recensione|resena)$",
)
GENERIC = {
    "index", "conclusion", "conclusions", "book reviews", "book review", "preface", "introduction", "vorwort", "bibliographie", "bibliography", "compte rendu", "comptes rendus", "avant propos", "editorial",
    "einleitung", "einfuhrung", "introduzione", "introduccion", "prefazione", "premessa", "foreword", "afterword", "postface", "nachwort", "abstracts", "resumes", "notes", "chronique", "errata", "table of contents",
    "table des matieres", "inhaltsverzeichnis", "literatur", "bibliografia", "indice", "register", "abkurzungen", "abbreviations", "reviews", "rezensionen", "recensioni", "resenas", "contributors", "front matter", "back matter",
}
ROMAN = re.compile(r"^(?=[ivx])(x{0,3})(ix|iv|v?i{0,3})(e|er|eme|es)?$")
# Abbreviations in titles, folded.
SHORT = {"jh": "jahrhundert", "jhs": "jahrhunderts", "jhdt": "jahrhundert", "jahrh": "jahrhundert", "cent": "century", "sec": "secolo", "s": "siecle", "hist": "history", "arch": "archaeology"}
LIGATURES = str.maketrans({"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "ı": "i"})


def fold(s: str | None) -> str:
    """Words in lower case without marks, tags and entities."""
    t = html.unescape(html.unescape(s or ""))
    t = re.sub(r"&(#?\w{1,8});?", lambda m: html.unescape(f"&{m[1]};"), re.sub(r"</?[a-zA-Z][^<>]*>", "", t))
    t = "".join(c for c in unicodedata.normalize("NFKD", t.lower()) if not unicodedata.combining(c)).translate(LIGATURES)
    return " ".join(re.findall(r"\w+", t.replace("_", " ")))


def _roman(w: str) -> int:
    m = ROMAN.match(w)
    if not m or not (m[1] or m[2]):
        return 0
    return 10 * len(m[1]) + {"": 0, "i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8, "ix": 9}[m[2]]


def title_of(raw: str | None) -> tuple[list[str], str, bool]:
    """Words, numbers and whether it's the title of a review. A word given twice in a row counts once;
    what follows an equals sign is the same title in another language."""
    t = fold((raw or "").split(" = ")[0])
    for d in DEBRIS:
        t = f" {t} ".replace(f" {d} ", " ").strip()
    review = False
    if t not in GENERIC:
        for r in REVIEWS:
            new = re.sub(r, "", t).strip()
            review, t = review or new != t, new
    words: list[str] = []
    numbers = []
    found = t.split()
    for i, w in enumerate(found):
        w = SHORT.get(w, w) if i else w
        if words and (w == words[-1] or (len(w) > 4 and osa(w, words[-1], 1) <= 1 and i + 1 < len(found))) and not w.isdigit():
            continue
        if len(words) > 1 and len(w) > 4 and w == words[-2]:
            continue
        words.append(w)
        n = int(w) if w.isdigit() and len(w) < 7 else int(m[1]) if (m := re.match(r"^(\d{1,3})(e|er|eme|th|st|nd|rd)$", w)) else _roman(w) if i and not (w in "ivx" and len(w) == 1 and i + 1 < len(found)) else 0
        if n:
            numbers.append(n)
    return words, ",".join(map(str, sorted(numbers))), review


def host_of(raw: str | None) -> list[str]:
    """Words of a host's title; a word that was cut off by a stop keeps it."""
    t = html.unescape(html.unescape(raw or ""))
    t = re.sub(r"^\s*in\s*:\s*", "", re.sub(r"</?[a-zA-Z][^<>]*>", "", t), flags=re.I)
    t = "".join(c for c in unicodedata.normalize("NFKD", t.lower()) if not unicodedata.combining(c)).translate(LIGATURES)
    return re.findall(r"\w+\.?", t)


def _word_like(a: str, b: str) -> bool:
    if a == b:
        return True
    n = max(len(a), len(b))
    if a.isdigit() or b.isdigit() or n < 4:
        return False
    return osa(a, b, 2) <= (1 if n < 8 else 2)


def host_likeness(a: list[str], b: list[str]) -> float:
    """Share of the words of the shorter host that the other has, abbreviated or misspelt; -1 where one is missing."""
    if not a or not b:
        return -1.0
    if a == b:
        return 1.0
    small, large = sorted((a, b), key=len)
    free, hit, total = list(large), 0, 0
    for w in small:
        weight = len(w.rstrip(".")) if len(w) > 3 else 1
        total += max(weight, 1)
        for x in free:
            v, y = w.rstrip("."), x.rstrip(".")
            if v == y or (w.endswith(".") and y.startswith(v)) or (x.endswith(".") and v.startswith(y)) or _word_like(v, y):
                hit += max(weight, 1)
                free.remove(x)
                break
    rest = sum(len(x) for x in free if len(x) > 3)
    return hit / total * (1.0 if rest < 4 else 0.8)


def title_likeness(a: list[str], b: list[str]) -> tuple[float, float]:
    """Share of the letters of the shorter and of the longer title that the other has, in any order."""
    if not a or not b:
        return 0.0, 0.0
    if a == b:
        return 1.0, 1.0
    small, large = (a, b) if sum(map(len, a)) <= sum(map(len, b)) else (b, a)
    free, hit_s, hit_l, odd = list(large), 0, 0, []
    for w in small:
        if w in free:
            free.remove(w)
            hit_s, hit_l = hit_s + len(w), hit_l + len(w)
        else:
            odd.append(w)
    for w in odd:
        for x in free:
            if _word_like(w, x):
                free.remove(x)
                hit_s, hit_l = hit_s + len(w), hit_l + len(x)
                break
    s, l = hit_s / sum(map(len, small)), hit_l / sum(map(len, large))
    if s < 0.9:  # words run together or cut apart
        x, y = "".join(a), "".join(b)
        if abs(len(x) - len(y)) <= 3 and indel_ratio(x, y) >= 0.94:
            return 0.95, 0.95
    return s, l
