"""Matching entities across sources without keys (problem 3).

Sorted neighbourhood: rows of both sources are sorted together by several composite keys made of the rarest
words of the title (also read backwards), the host, the year, the numbers and an author; in every order each
row is compared with the rows of the other source within a window. Pairs that numbers, year or kind don't
part get a confidence from weighted similarities of title, host, year and authors; an assignment of at most
one partner to each row then maximises the total confidence.

Rows of one source that are equal in all that is compared, authors included, are one class with a capacity
before any pair is made: copies neither fill windows nor enlarge components. The order is a range
partitioning, its ranks come from the sizes of the partitions; a window reaches over the border of partitions
by blocks of ranks. The work grows with the rows, whatever the keys' frequencies: of equal keys the further
fields decide the order. A pair goes on if the titles share words of a third of the shorter one's letters or
are within a fifth of edits of each other; this is tested natively in the window, before pairs are shuffled.
Authors are compared by joins, not by collected lists. The assignment is exact for every component of
candidate pairs, by shortest augmenting paths over its sparse pairs with the classes' capacities; a component
is the work of one task and holds distinct records only, of which none has more than 100 pairs.

Defined results: a row without a title matches nothing; a missing host, year or author doesn't speak against
a match and lowers its confidence; repeated ids count once; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import indel_ratio
from ..session import cut, partitions
from .components import alternating_stars
from .names import NICK, parse
from .publications import GENERIC, host_likeness, host_of, title_likeness, title_of

WEIGHTS = {"title": 0.55, "host": 0.17, "year": 0.08, "authors": 0.2}
WINDOW = 10
LEAST = 0.6
SCHEMA = "id string, src int, words array<string>, host array<string>, numbers string, review boolean, generic boolean, year int"


def parallel(df: DataFrame, *keys: str) -> DataFrame:
    """df partitioned by keys for Python work on every core; a distinct on them needs no further shuffle."""
    return df.repartition(partitions(df), *keys)


def records(df: DataFrame, src: int) -> DataFrame:
    """df: id (string), title, host, year."""
    def run(batches: Iterator) -> Iterator:
        for b in batches:
            t = [title_of(x) for x in b["title"]]
            yield b[["id", "year"]].assign(src=src, words=[x[0] for x in t], numbers=[x[1] for x in t], review=[x[2] for x in t],
                host=[host_of(x) for x in b["host"]], generic=[" ".join(x[0]) in GENERIC or len(x[0]) < 3 for x in t])[["id", "src", "words", "host", "numbers", "review", "generic", "year"]].astype({"year": "Int32", "src": "int32"})

    return parallel(df.where("id IS NOT NULL"), "id").dropDuplicates(["id"]).mapInPandas(run, SCHEMA).where("size(words) > 0")


def authors(df: DataFrame) -> DataFrame:
    """(id, family, letter) of distinct names. df: id, name."""
    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for b in batches:
            out = []
            for i, n in zip(b["id"], b["name"]):
                kind, first, rest = parse(n)
                if kind == "person":
                    out.append((i, "".join(first), NICK.get(rest[0], rest[0])[:1] if rest else ""))
                elif kind == "open":
                    given = [NICK.get(w, w)[:1] for w in (first[0], first[-1])] if len(first) > 1 else ["", ""]
                    out += [(i, first[-1], given[0]), (i, first[0], given[1])]
                elif kind == "org":
                    out += [(i, w, "") for w in rest]
            yield pd.DataFrame([x for x in out if len(x[1]) > 1], columns=["id", "family", "letter"])

    return parallel(df.where("id IS NOT NULL AND name IS NOT NULL"), "id", "name").distinct().mapInPandas(run, "id string, family string, letter string").distinct()


def _ranked(df: DataFrame, order: list[str], parts: int) -> DataFrame:
    """df with its global rank by `order`, cut: a range partitioning and the sizes of its partitions."""
    s = cut(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    s = s.withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = sorted((r._part, r["count"]) for r in s.groupBy("_part").count().collect())  # one row for each partition
    total, offsets = 0, []
    for p, n in sizes:
        offsets.append((p, total))
        total += n
    before = F.broadcast(df.sparkSession.createDataFrame(offsets or [(0, 0)], "_part bigint, _before bigint"))  # one row for each partition
    return s.join(before, "_part").withColumn("rank", F.col("_at") + F.col("_before")).drop("_at", "_part", "_before")


def classes(both: DataFrame, names: DataFrame) -> DataFrame:
    """(src, id, rep, n) of every record: the smallest id of those that are equal to it, and their number. names:
    src, id, family, letter."""
    who = names.groupBy("src", "id").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("family", "letter")).alias("x"))
    same = [F.array_join("words", " "), F.array_join("host", " "), F.col("numbers"), F.col("review"), F.col("generic"), F.col("year"), F.col("c"), F.col("x")]
    keyed = both.join(who, ["src", "id"], "left").select("src", "id", F.xxhash64(*same).alias("k"), F.xxhash64(F.lit(1), *same).alias("k2"))
    reps = keyed.groupBy("src", "k", "k2").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    return keyed.join(reps, ["src", "k", "k2"]).select("src", "id", "rep", "n")


def candidates(both: DataFrame, names: DataFrame, window: int = WINDOW) -> DataFrame:
    """(l, r) pairs of a row of source 0 and one of source 1 within a window of some order that numbers, year,
    kind and the letters of the titles don't part. names: src, id, family, letter."""
    word = both.select("id", "src", F.explode("words").alias("w")).where(F.length("w") > 2)
    df = word.groupBy("w").agg(F.count("*").alias("n"))
    rare = word.join(df, "w").groupBy("id", "src").agg(F.slice(F.array_sort(F.collect_set(F.struct("n", "w"))), 1, 3).alias("rare"))
    one = names.groupBy("src", "id").agg(F.min(F.concat_ws(" ", "family", "letter")).alias("author"))
    k = both.join(rare, ["id", "src"], "left").join(one, ["src", "id"], "left")
    w = [F.coalesce(F.get("rare", F.lit(i))["w"], F.lit("")) for i in range(3)]
    year = F.coalesce(F.col("year").cast("string"), F.lit(""))
    host = F.array_join("host", " ")
    numbers = F.concat(F.lit("#"), "numbers", F.lit("#"), F.col("review").cast("string"))
    core = F.array_join(F.array_sort(F.filter("words", lambda x: F.length(x) > 3)), " ")
    generic_key = F.concat_ws("|", F.array_join("words", " "), F.reverse(host), year)
    keys = [
        F.concat_ws("|", w[0], w[1], numbers, year, host),
        F.concat_ws("|", F.reverse(w[0]), F.reverse(w[1]), numbers, year, host),
        F.concat_ws("|", w[1], w[0], numbers, year, host),
        F.concat_ws("|", F.coalesce("author", F.lit("~")), year, w[0], host),
        F.concat_ws("|", F.reverse(host), year, w[0], core),
    ]
    passes = F.explode(F.transform(F.array(*[F.struct(F.lit(i).alias("pass"), F.when(F.col("generic") & F.lit(i < 3), F.concat(F.lit(f"{i}"), generic_key)).otherwise(x).alias("key")) for i, x in enumerate(keys)]), lambda x: x)).alias("p")
    must = F.xxhash64("numbers", "review", "generic").alias("must")
    keyed = k.select("id", "src", "words", "year", must, passes).select("id", "src", "words", "year", "must", "p.pass", "p.key")
    s = _ranked(keyed.withColumn("h", F.xxhash64("id", "src")), ["pass", "key", "h", "src", "id"], partitions(both, 2 * len(keys)))
    block = F.floor(F.col("rank") / window)
    left = s.where("src = 0").select("pass", F.col("id").alias("l"), F.col("rank").alias("x"), F.col("words").alias("wx"), F.col("year").alias("yx"), F.col("must").alias("mx"), F.explode(F.array(block - 1, block, block + 1)).alias("block"))
    right = s.where("src = 1").select("pass", F.col("id").alias("r"), F.col("rank").alias("y"), F.col("words").alias("wy"), F.col("year").alias("yy"), F.col("must").alias("my"), block.alias("block"))
    near = left.join(right, ["pass", "block"]).where((F.abs(F.col("x") - F.col("y")) <= window) & (F.col("mx") == F.col("my")) & F.coalesce(F.abs(F.col("yx") - F.col("yy")) <= 1, F.lit(True)))
    tx, ty = F.array_join("wx", ""), F.array_join("wy", "")
    shared = F.length(F.array_join(F.array_intersect("wx", "wy"), ""))
    longer = F.greatest(F.length(tx), F.length(ty))
    return near.where((shared * 3 >= F.least(F.length(tx), F.length(ty))) | (F.call_function("levenshtein", tx, ty, (longer * F.lit(0.2)).cast("int")) >= 0)).select("l", "r").distinct()


def confidences(both: DataFrame, names_l: DataFrame, names_r: DataFrame, pairs: DataFrame) -> DataFrame:
    """(l, r, confidence) of the pairs that may be one publication."""
    def side(src: int, p: str) -> DataFrame:
        return both.where(F.col("src") == src).select(F.col("id").alias(p), F.col("words").alias(p + "w"), F.col("host").alias(p + "h"), F.col("generic").alias(p + "g"), F.col("year").alias(p + "y"))

    p = pairs.join(side(0, "l"), "l").join(side(1, "r"), "r").repartition(partitions(both), "l", "r")

    def compare(batches: Iterator) -> Iterator:
        import numpy as np

        for b in batches:
            rows = []
            for lw, rw, lh, rh in zip(b["lw"], b["rw"], b["lh"], b["rh"]):
                lw, rw, lh, rh = list(lw), list(rw), list(lh), list(rh)
                short, long = title_likeness(lw, rw)
                rows.append((short, long, 0.5 * (short * 0.6 + long * 0.4) + 0.5 * indel_ratio(" ".join(lw), " ".join(rw)) if short >= 0.85 else 0.0, host_likeness(lh, rh)))
            x = np.array(rows, float).reshape(-1, 4)
            ok = (x[:, 0] >= 0.85) & ((x[:, 3] < 0) | (x[:, 3] >= 0.6)) & (~b["lg"].to_numpy(bool) | (x[:, 3] >= 0.85))
            b = b.assign(short=x[:, 0], long=x[:, 1], title=x[:, 2], host=x[:, 3])[ok]
            yield b[["l", "r", "ly", "ry", "lg", "short", "long", "title", "host"]].astype({"ly": "Int32", "ry": "Int32"})

    c = cut(p.mapInPandas(compare, "l string, r string, ly int, ry int, lg boolean, short double, long double, title double, host double"))
    met = c.select("l", "r").join(names_l.select(F.col("id").alias("l"), F.col("family").alias("fl"), F.col("letter").alias("gl")), "l").join(names_r.select(F.col("id").alias("r"), F.col("family").alias("fr"), F.col("letter").alias("gr")), "r")
    room = F.when(F.least(F.length("fl"), F.length("fr")) < 5, 0).when(F.least(F.length("fl"), F.length("fr")) < 7, 1).otherwise(2)
    same = ((F.col("fl") == F.col("fr")) | (F.levenshtein("fl", "fr") <= room)) & ((F.col("gl") == "") | (F.col("gr") == "") | (F.col("gl") == F.col("gr")))
    met = met.groupBy("l", "r").agg(F.max(same.cast("int")).alias("same"))
    c = c.join(met, ["l", "r"], "left")
    authors_s = F.when(F.col("same") == 1, 1.0).when(F.col("same") == 0, 0.0)
    host_s = F.when(F.col("host") >= 0, F.col("host"))
    year_s = F.when(F.col("ly").isNotNull() & F.col("ry").isNotNull(), F.when(F.col("ly") == F.col("ry"), 1.0).otherwise(0.6))
    parts = [(WEIGHTS["title"], F.col("title")), (WEIGHTS["host"], host_s), (WEIGHTS["year"], year_s), (WEIGHTS["authors"], authors_s)]
    known = sum((F.when(v.isNotNull(), F.lit(w)).otherwise(0.0) for w, v in parts), F.lit(0.0))
    score = sum((F.coalesce(v * w, F.lit(0.0)) for w, v in parts), F.lit(0.0)) / known
    # what is missing lowers the confidence a little
    return c.select("l", "r", F.round(score * (0.85 + 0.15 * known), 6).alias("confidence"), "lg", "long", "title", "host", F.col("same"))


def best_assignment(weights: dict[tuple[str, str], float], left: dict[str, int] | None = None, right: dict[str, int] | None = None) -> dict[tuple[str, str], int]:
    """How often each pair is made in an assignment of the largest total. left, right: how many partners a row may
    have, else one. Shortest augmenting paths with potentials over the sparse pairs; a search ends at the first
    row with room, or where staying alone costs less."""
    import heapq

    left, right = left or {}, right or {}
    cost: dict[str, list[tuple[str, int]]] = {}
    for (a, b), x in sorted(weights.items()):
        cost.setdefault(a, []).append((b, -round(x * 1e6)))
    pl = {a: max(-c for _, c in e) for a, e in cost.items()}  # potentials; those of the other side start at 0
    pr: dict[str, int] = {}
    room = {b: right.get(b, 1) for e in cost.values() for b, _ in e}
    flow: dict[tuple[str, str], int] = {}
    into: dict[str, set[str]] = {}
    w = {(a, b): c for a, e in cost.items() for b, c in e}
    for source in cost:
        supply = left.get(source, 1)
        while supply:
            seen_l: dict[str, int] = {}
            seen_r: dict[str, int] = {}
            back_l: dict[str, str] = {}
            best_r: dict[str, tuple[int, str]] = {}
            heap: list[tuple[int, int, str]] = [(0, 1, source)]
            low_l = {source: 0}
            end, total = None, None  # the end of the path: a row with room (0) or one that stays alone (1)
            while heap:
                d, side, x = heapq.heappop(heap)
                if end is not None and d >= total:
                    break
                if side:
                    if x in seen_l or d > low_l[x]:
                        continue
                    seen_l[x] = d
                    alone = d + pl[x]
                    if total is None or alone < total:
                        end, total = (1, x), alone
                    for b, c in cost[x]:
                        if b not in seen_r:
                            v = d + c + pl[x] - pr.get(b, 0)
                            if b not in best_r or v < best_r[b][0]:
                                best_r[b] = (v, x)
                                heapq.heappush(heap, (v, 0, b))
                else:
                    if x in seen_r or d > best_r[x][0]:
                        continue
                    seen_r[x] = d
                    if room[x]:
                        if d + pr.get(x, 0) < total:
                            end, total = (0, x), d + pr.get(x, 0)
                    for a in into.get(x, ()):
                        v = d - w[a, x] + pr.get(x, 0) - pl[a]
                        if a not in seen_l and (a not in low_l or v < low_l[a]):
                            low_l[a], back_l[a] = v, x
                            heapq.heappush(heap, (v, 1, a))
            for x, d in seen_l.items():
                pl[x] += min(d, total) - total
            for x, d in seen_r.items():
                pr[x] = pr.get(x, 0) + min(d, total) - total
            # back along the path: pairs that are made, and between them pairs that are given up
            side, x = end
            made, given = [], []
            while True:
                if not side:
                    a = best_r[x][1]
                    made.append((a, x))
                    x, side = a, 1
                elif x == source:
                    break
                else:
                    b = back_l[x]
                    given.append((x, b))
                    x, side = b, 0
            k = min([supply, *([room[end[1]]] if not end[0] else []), *(flow[p] for p in given)])
            supply -= k
            if not end[0]:
                room[end[1]] -= k
            for a, b in given:
                flow[a, b] -= k
                if not flow[a, b]:
                    del flow[a, b]
                    into[b].discard(a)
            for a, b in made:
                flow[a, b] = flow.get((a, b), 0) + k
                into.setdefault(b, set()).add(a)
    return flow


def assign(edges: DataFrame) -> DataFrame:
    """(l, r, confidence, k): the assignment of the largest total, pair (l, r) k times. edges: l, r, confidence,
    nl, nr, how many partners each end may have."""
    e = cut(edges.select("l", "r", "confidence", "nl", "nr", F.xxhash64(F.lit(0), "l").alias("a"), F.xxhash64(F.lit(1), "r").alias("b")))
    groups = alternating_stars(e.select("a", "b"))
    sized = e.join(groups.select(F.col("id").alias("a"), "group_id"), "a")
    n = sized.groupBy("group_id").agg(F.count("*").alias("n"))
    sized = cut(sized.join(n, "group_id").select("l", "r", "confidence", "nl", "nr", "group_id", "n"))
    schema = "l string, r string, confidence double, k bigint"

    def solve(pdf):
        import pandas as pd

        w = {(a, b): float(x) for a, b, x in zip(pdf["l"], pdf["r"], pdf["confidence"])}
        made = best_assignment(w, dict(zip(pdf["l"], map(int, pdf["nl"]))), dict(zip(pdf["r"], map(int, pdf["nr"]))))
        return pd.DataFrame([(a, b, w[a, b], k) for (a, b), k in made.items()], columns=["l", "r", "confidence", "k"])

    done = sized.where("n = 1").select("l", "r", "confidence", F.least("nl", "nr").alias("k"))
    return done.unionAll(sized.where("n > 1").groupBy("group_id").applyInPandas(solve, schema))


def expand(made: DataFrame, members: DataFrame) -> DataFrame:
    """(l, r, confidence) of records, from pairs of classes that are made k times: the members of a class in the
    order of their ids go to its partners in theirs. members: src, id, rep."""
    made = cut(made)
    before = lambda side, other: F.coalesce(F.sum("k").over(Window.partitionBy(side).orderBy(other).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    made = made.withColumn("ol", before("l", "r")).withColumn("or", before("r", "l"))  # a class has few partners
    used = made.select(F.lit(0).alias("src"), F.col("l").alias("rep")).unionAll(made.select(F.lit(1), "r")).distinct()
    ranked = _ranked(members.join(used, ["src", "rep"], "left_semi").select("src", "id", "rep"), ["src", "rep", "id"], partitions(members))
    start = ranked.groupBy("src", "rep").agg(F.min("rank").alias("start"))
    at = cut(ranked.join(start, ["src", "rep"]).select("src", "rep", "id", (F.col("rank") - F.col("start")).alias("i")))
    left = made.join(at.where("src = 0").select(F.col("rep").alias("l"), F.col("id").alias("lid"), "i"), "l").where("i >= ol AND i < ol + k").select("lid", "r", "confidence", (F.col("i") - F.col("ol") + F.col("or")).alias("i"))
    right = at.where("src = 1").select(F.col("rep").alias("r"), F.col("id").alias("rid"), "i")
    return left.join(right, ["r", "i"]).select(F.col("lid").alias("l"), F.col("rid").alias("r"), "confidence")


def link(reference: DataFrame, ecriture: DataFrame, author_table: DataFrame, items: DataFrame, least: float = LEAST) -> DataFrame:
    """(reference_id, item_id, confidence)."""
    left = records(reference.select(F.col("id").cast("string").alias("id"), "title", F.col("secondary_title").alias("host"), F.col("year").cast("int").alias("year")), 0)
    year = F.regexp_extract(F.coalesce("published_date", F.lit("")), r"^\s*([12][0-9]{3})", 1)
    right = records(items.select(F.col("item_id").alias("id"), "title", F.col("is_part_of").alias("host"), F.when(year != "", year.try_cast("int")).alias("year")), 1)
    both = cut(left.unionByName(right))
    links = ecriture.where("reference_id IS NOT NULL AND author_id IS NOT NULL").select(F.col("reference_id").cast("string").alias("id"), F.col("author_id").alias("aid")).distinct()
    names_l = cut(authors(links.join(author_table.select(F.col("id").alias("aid"), F.col("NomComplet").alias("name")), "aid").select("id", "name")))
    listed = items.select(F.col("item_id").alias("id"), F.explode("creators").alias("c")).select("id", F.concat_ws(", ", "c.last_name", "c.first_name").alias("name"))
    # a comma parts two names where there is a space on either side of it in each of them
    string = F.regexp_replace("creators_string", r"\s+(and|et|und|y|e|&)\s+", ";")
    string = F.when(string.rlike(r"^[^,;\s]+(\s+[^,;\s]+)+(\s*[,;]\s*[^,;\s]+(\s+[^,;\s]+)+)+$"), F.regexp_replace(string, ",", ";")).otherwise(string)
    loose = items.where("creators IS NULL OR size(creators) = 0").select(F.col("item_id").alias("id"), F.explode(F.split(string, r"\s*;\s*")).alias("name"))
    names_r = cut(authors(listed.unionAll(loose)))
    names = names_l.withColumn("src", F.lit(0)).unionByName(names_r.withColumn("src", F.lit(1)))
    members = cut(classes(both, names))
    reps = members.where("id = rep").select("src", "id", "n")
    both = cut(both.join(reps.select("src", "id"), ["src", "id"], "left_semi"))
    pairs = candidates(both, names.join(reps.select("src", "id"), ["src", "id"], "left_semi"))
    c = confidences(both, names_l, names_r, pairs).where(F.col("confidence") >= least)
    size = lambda src, to, n: reps.where(F.col("src") == src).select(F.col("id").alias(to), F.col("n").alias(n))
    made = assign(c.select("l", "r", "confidence").join(size(0, "l", "nl"), "l").join(size(1, "r", "nr"), "r"))
    return expand(made, members).select(F.col("l").cast("bigint").alias("reference_id"), F.col("r").alias("item_id"), "confidence")
