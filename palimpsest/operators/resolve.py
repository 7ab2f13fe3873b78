"""Entity resolution and record linkage: blocks, pairs, clusters, survivors, and how decisions apply."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.near import meetings, signatures
from ..functions.similarity import indel_ratio_udf, may_reach
from ..session import cut, partitions
from .graph import components
from .tabular import block_pairs, filled


def native_ratio(a: Column, b: Column) -> Column:
    """Levenshtein similarity 1 - distance / longer length; 0 where a side is empty."""
    n = F.greatest(F.length(a), F.length(b))
    return F.when((F.coalesce(F.length(a), F.lit(0)) == 0) | (F.coalesce(F.length(b), F.lit(0)) == 0), 0.0).otherwise(1 - F.levenshtein(a, b) / n)


def native_at_least(a: Column, b: Column, threshold: float) -> Column:
    """Whether native_ratio reaches the threshold, by lengths first and then a bounded distance."""
    room = (F.greatest(F.length(a), F.length(b)) * F.lit(1 - threshold) + 1e-9).cast("int")
    return (F.abs(F.length(a) - F.length(b)) <= room) & (F.call_function("levenshtein", a, b, room) >= 0)


def similar_pairs(pairs: DataFrame, a: str, b: str, threshold: float) -> DataFrame:
    """pairs whose indel ratio reaches the threshold, with `score`. Native bounds come first: equal texts
    need no UDF, impossible pairs none either."""
    p = pairs.where((F.col(a) != "") & (F.col(b) != "") & may_reach(F.col(a), F.col(b), threshold))
    return p.withColumn("score", indel_ratio_udf()(F.col(a), F.col(b))).where(F.col("score") >= threshold)


def exact_groups(df: DataFrame, key: str, id_: str = "id") -> DataFrame:
    """(key, keep, members) of values that at least two rows share."""
    d = df.where(filled(F.col(key))).groupBy(key).agg(F.count("*").alias("members"), F.min(id_).alias("keep"))
    return d.where("members > 1")


def suggestions(labels: DataFrame, id_: str = "id", group: str = "component") -> DataFrame:
    """(group, id, action): keep for the smallest id, delete for the others."""
    keep = labels.groupBy(group).agg(F.min(id_).alias("_keep"), F.count("*").alias("_n")).where("_n > 1")
    return labels.join(keep, group).select(group, id_, F.when(F.col(id_) == F.col("_keep"), "keep").otherwise("delete").alias("action"))


def cluster_pairs(pairs: DataFrame) -> DataFrame:
    """(id, component) of pairs a, b."""
    return components(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")))


def signature_clusters(df: DataFrame, threshold: float = 0.85, least: int = 4) -> DataFrame:
    """Names in another order: one minimal signature, full signatures alike. df: id, minimal, full."""
    p = block_pairs(df.where(F.length("minimal") >= least), "id", "minimal", "full")
    return cluster_pairs(similar_pairs(p, "x_full", "y_full", threshold))


def initial_clusters(df: DataFrame, match: Callable[[Column, Column], Column], threshold: float = 0.85) -> DataFrame:
    """One family name, and given names alike or one the initial of the other. df: id, family, given."""
    p = block_pairs(df.where(filled(F.col("family")) & filled(F.col("given"))), "id", "family", "given")
    short = p.where(match(F.col("x_given"), F.col("y_given"))).select("a", "b")
    return cluster_pairs(short.unionAll(similar_pairs(p, "x_given", "y_given", threshold).select("a", "b")).distinct())


def transliterated_clusters(df: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Latin forms with one beginning, at least one from another script. df: id, latin, script."""
    d = df.where(F.length("latin") >= 2).withColumn("block", F.substring("latin", 1, 2))
    other = d.where("script IS NOT NULL").select("block", F.col("id").alias("a"), F.col("latin").alias("x"), F.col("script").alias("_s"))
    p = other.join(d.select("block", F.col("id").alias("b"), F.col("latin").alias("y"), "script"), "block").where("a <> b AND (script IS NULL OR a < b)").select("a", "b", "x", "y")
    return cluster_pairs(similar_pairs(p, "x", "y", threshold))


def shared_identifier_clusters(df: DataFrame, fields: list[str], id_: str = "id") -> DataFrame:
    """(id, component) of rows that share a value of a field, chained. A value links its rows to their
    smallest id, not to each other."""
    v = df.select(F.col(id_).alias("id"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("v")).select("id", "v.field", "v.value").where(filled(F.col("value"))).distinct()
    hub = v.groupBy("field", "value").agg(F.min("id").alias("u"), F.count("*").alias("n")).where("n > 1")
    return components(v.join(hub, ["field", "value"]).where("id <> u").select("u", F.col("id").alias("v")))


def conflicts(members: DataFrame, group: str, fields: list[str]) -> DataFrame:
    """(group, fields): the fields with more than one value in a group."""
    n = members.groupBy(group).agg(*[F.count_distinct(F.when(filled(F.col(f)), F.col(f))).alias(f) for f in fields])
    names = F.filter(F.array(*[F.when(F.col(f) > 1, F.lit(f)) for f in fields]), lambda x: x.isNotNull())
    return n.select(group, names.alias("fields")).where(F.size("fields") > 0)


def info_score(fields: list[str]) -> Column:
    return sum((filled(F.col(f)).cast("int") for f in fields), F.lit(0))


def elect(members: DataFrame, group: str, order: list[Column], id_: str = "id") -> DataFrame:
    """(group, survivor): the first member by order; ties must be broken in it. order: ascending columns."""
    best = members.groupBy(group).agg(F.min(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.col(id_).alias("survivor"))).alias("b"))
    return best.select(group, "b.survivor")


def merge_fields(members: DataFrame, group: str, fields: list[str], id_: str = "id") -> DataFrame:
    """(group, fields): each field's first filled value in the order of ids."""
    return members.groupBy(group).agg(*[F.min(F.when(filled(F.col(f)), F.struct(id_, f)))[f].alias(f) for f in fields])


def doi_groups(refs: DataFrame, doi: str, year: str, fields: list[str], available: list[str]) -> DataFrame:
    """One survivor for each DOI, or for each DOI and year where the years spread over more than one; the
    survivor has the most filled fields (then the smallest id), availability is the group's largest."""
    d = refs.where(filled(F.col(doi)))
    span = d.groupBy(doi).agg(F.coalesce(F.max(year) - F.min(year), F.lit(0)).alias("spread"), F.count("*").alias("n")).where("n > 1").select(doi, "spread")
    d = d.join(span, doi).withColumn("part", F.when(F.col("spread") > 1, F.col(year)))
    best = F.min(F.struct((-info_score(fields)).alias("s"), F.col("id").alias("i")))["i"].alias("survivor")
    return d.groupBy(doi, "part").agg(best, F.count("*").alias("members"), F.min(year).alias("first_year"), *[F.max(c).alias(c) for c in available])


def valid_decisions(decisions: DataFrame, group: str = "group_id") -> DataFrame:
    """(group, keep, deleted) of groups with exactly one keep, something to delete and nothing to skip.
    decisions: group, member, action."""
    a = F.col("action")
    d = decisions.groupBy(group).agg(F.sum((a == "keep").cast("int")).alias("keeps"), F.sum((a == "skip").cast("int")).alias("skips"), F.sum((a == "delete").cast("int")).alias("deletes"), F.min(F.when(a == "keep", F.col("member"))).alias("keep")).where("keeps = 1 AND skips = 0 AND deletes > 0")
    return decisions.where(a == "delete").join(d.select(group, "keep"), group).select(group, "keep", F.col("member").alias("deleted"))


def relink(links: DataFrame, unit: str, partner: str, merged: DataFrame) -> DataFrame:
    """Distinct links with the deleted ends replaced by those that stay. merged: keep, deleted."""
    m = merged.select(F.col("deleted").alias(partner), "keep").distinct()
    return links.select(unit, partner).join(m, partner, "left").select(unit, F.coalesce("keep", partner).alias(partner)).distinct()


def apply_merge(rows: DataFrame, merged: DataFrame, maxima: list[str], companions: dict[str, str] | None = None, earliest: list[str] = (), now: Column | None = None, modified: str | None = None) -> DataFrame:
    """The table after a merge: survivors take the group's maxima, the companion of each maximum (its
    reliability) and the earliest year; deleted rows go; `modified` becomes `now` only where a value changed."""
    companions = companions or {}
    to = merged.select(F.col("deleted").alias("id"), F.col("keep").alias("_keep")).distinct()
    d = rows.join(to, "id", "left").withColumn("_keep", F.coalesce("_keep", "id"))
    agg = [F.max(c).alias(f"_{c}") for c in maxima] + [F.max_by(r, F.struct(F.col(c), -F.col("id"))).alias(f"_{r}") for c, r in companions.items()] + [F.min(c).alias(f"_{c}") for c in earliest]
    new = d.groupBy("_keep").agg(*agg).withColumnRenamed("_keep", "id")
    cols = [*maxima, *companions.values(), *earliest]
    out = rows.join(to, "id", "left_anti").join(new, "id")
    differs = F.lit(False)
    for c in cols:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    if modified:
        out = out.withColumn(modified, F.when(differs, now).otherwise(F.col(modified)))
    return out.withColumns({c: F.col(f"_{c}") for c in cols}).drop(*[f"_{c}" for c in cols])


def transfer_set(pairs: DataFrame, owner: str, value: str, merged: DataFrame) -> DataFrame:
    """Owner-value pairs (keywords) after a merge, each once."""
    return relink(pairs.select(F.col(value), F.col(owner)), value, owner, merged).select(owner, value)


def rare_grams(df: DataFrame, key: str, threshold: float, indel: bool = True, id_: str = "id") -> DataFrame:
    """(id, gram): so many of a string's rarest grams that any two strings which reach the threshold - of the indel
    ratio, else of Levenshtein's similarity - share one of them. Grams are of three letters, of which an edit changes
    three at most, and of two below an indel ratio of 0.88; thresholds go down to 0.67."""
    n, size = F.length("k"), 2 if indel and threshold < 0.88 else 3
    most = n * F.lit((2 - threshold) / threshold if indel else 1 / threshold)  # of a string that may be like it
    edits = F.floor((n + most if indel else most) * F.lit(1 - threshold) + 1e-9).cast("int")
    d = df.select(F.col(id_).alias("id"), F.col(key).alias("k")).where("k <> ''")
    padded = F.concat(F.lit("\x02"), F.col("k"), F.lit("\x03"))
    g = d.select("id", (size * edits + 1).alias("take"), F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), n + 3 - size), lambda i: F.substring(padded, i, F.lit(size))))).alias("gram"))
    counts = g.groupBy("gram").agg(F.count("*").alias("n"))
    own = g.join(counts, "gram").groupBy("id", "take").agg(F.array_sort(F.collect_list(F.struct("n", "gram"))).alias("g"))  # a string's own grams
    return own.select("id", F.explode(F.slice("g", F.lit(1), F.col("take"))).alias("g")).select("id", "g.gram")


TILE = 16_000  # rows of one side that a task compares with as many of the other


def near_pairs(left: DataFrame, right: DataFrame | None, threshold: float, indel: bool = True) -> DataFrame:
    """(a, b, x, y): strings of one block that may reach the threshold of the indel ratio, else of Levenshtein's
    similarity; without a right side pairs of the left one, a < b. left, right: id, k, block. No pair is lost: a cell
    holds a block's strings of a class of lengths and those of its neighbours, in tiles of bounded size, and bounds on
    whole ranges take the place of rows for each common gram."""
    low = threshold / (2 - threshold) if indel else threshold  # of lengths
    own = right is None

    def rows(df: DataFrame, side: int, around: list[int]) -> DataFrame:
        c = F.floor(F.log(F.length("k").cast("double")) / F.lit(-math.log(low))).cast("int")
        d = df.where(F.length("k") > 0).select("block", F.lit(side).alias("side"), F.col("id").alias("a" if not side else "b"), "k", c.alias("class"))
        return d.withColumn("cell", F.explode(F.array(*[F.col("class") - i for i in around])))

    # a little more than the neighbours, as a length on the border of a class may be rounded to either side
    both = rows(left, 0, [0]).unionByName(rows(left if own else right, 1, [0, 1, 2] if own else [-2, -1, 0, 1, 2]), allowMissingColumns=True)
    both = cut(both)
    sizes = both.groupBy("block", "cell").agg(F.sum((F.col("side") == 0).cast("int")).alias("n"), F.sum(F.col("side")).alias("m")).where("n > 0 AND m > 1" if own else "n > 0 AND m > 0")
    parts = lambda c: F.floor((F.col(c) - 1) / TILE + 1).cast("int")
    d = both.join(sizes.select("block", "cell", parts("n").alias("n"), parts("m").alias("m")), ["block", "cell"])
    at = F.pmod(F.xxhash64(F.coalesce(F.col("a").cast("string"), F.col("b").cast("string"))), F.when(F.col("side") == 0, F.col("n")).otherwise(F.col("m"))).cast("int")
    tiles = F.when(F.col("side") == 0, F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda j: at * F.col("m") + j)).otherwise(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: i * F.col("m") + at))
    d = d.select("block", "cell", F.explode(tiles).alias("tile"), "side", "class", "a", "b", "k")
    kinds = dict(d.dtypes)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        def met(g) -> Iterator:
            g = g.reset_index(drop=True)
            key = g.groupby(["block", "cell", "tile"], sort=False).ngroup().to_numpy()
            text = g["k"].tolist()
            size, reached, held = signatures(text)
            side, cls = g["side"].to_numpy(), g["class"].to_numpy()
            order = np.lexsort((size, side, key))
            size, reached, held, side, cls, key = size[order], reached[:, order], held[:, order], side[order], cls[order], key[order]
            ids = [g["a"].to_numpy()[order], g["b"].to_numpy()[order]]
            text = np.array(text, dtype=object)[order]
            mine = np.flatnonzero(side == 0)
            place = (key * 2 + side) * (size.max() + 1) + size  # in one order
            base = (key[mine] * 2 + 1) * (size.max() + 1)
            room = lambda n: np.minimum(n, size.max())
            first = np.searchsorted(place, base + np.ceil(size[mine] * low - 1e-6).astype(np.int64))
            last = np.searchsorted(place, base + room(np.floor(size[mine] / low + 1e-6).astype(np.int64)), "right")
            i, j, n = [], [], 0

            def out():
                x, y = np.concatenate(i), np.concatenate(j)
                p, q = ids[0][x], ids[1][y]
                if own:
                    keep = (cls[x] < cls[y]) | ((cls[x] == cls[y]) & (p < q))
                    x, y, p, q = x[keep], y[keep], p[keep], q[keep]
                    swap = p > q
                    x, y, p, q = np.where(swap, y, x), np.where(swap, x, y), np.where(swap, q, p), np.where(swap, p, q)
                return pd.DataFrame({"a": p, "b": q, "x": text[x], "y": text[y]})

            for x, y in meetings(size, reached, held, mine, first, last, 1 - threshold, indel):
                i.append(x)
                j.append(y)
                n += len(x)
                if n > 50_000:
                    yield out()
                    i, j, n = [], [], 0
            if n:
                yield out()

        kept = None
        for batch in batches:
            kept = batch if kept is None else pd.concat([kept, batch], ignore_index=True)
            if len(kept) < TILE:
                continue
            end = kept.iloc[-1][["block", "cell", "tile"]]
            open_ = ((kept["block"] == end["block"]) & (kept["cell"] == end["cell"]) & (kept["tile"] == end["tile"])).to_numpy()
            if not open_.all():
                yield from met(kept[~open_])
                kept = kept[open_]
        if kept is not None and len(kept):
            yield from met(kept)

    d = d.repartition(partitions(both, 4, 1 << 20), "block", "cell", "tile").sortWithinPartitions("block", "cell", "tile")
    d = d.withColumns({c: F.coalesce(c, F.lit(0 if kinds[c] != "string" else "").cast(kinds[c])) for c in ("a", "b")})
    return d.mapInPandas(run, f"a {kinds['a']}, b {kinds['b']}, x string, y string")


def like_pairs(keys: DataFrame, threshold: float, right: DataFrame | None = None) -> DataFrame:
    """(a, b, x, y, score), a < b: strings of one block whose indel ratio reaches the threshold. keys: id, k, block. With
    a right side pairs of one of keys and one of it. No pair is lost."""
    p = near_pairs(keys, right, threshold)
    room = ((F.length("x") + F.length("y")) * F.lit(1 - threshold) + 1e-9).cast("int")
    return similar_pairs(p.where(F.call_function("levenshtein", F.col("x"), F.col("y"), room) >= 0), "x", "y", threshold)


def like_between(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(a, b, score): strings of two tables whose native ratio reaches the threshold. left, right: id, k."""
    whole = lambda d: d.select("id", "k", F.lit("").alias("block"))
    p = near_pairs(whole(left), whole(right), threshold, indel=False)
    return p.where(native_at_least(F.col("x"), F.col("y"), threshold)).select("a", "b", native_ratio(F.col("x"), F.col("y")).alias("score"))


def _together(component: str, df: DataFrame) -> Column:
    """A number that many components share, for rules that settle them side by side: a group for each would take longer
    to begin than to settle."""
    return F.pmod(F.xxhash64(component), F.lit(partitions(df, 4, 4 << 20)))


def greedy_leaders(df: DataFrame, block: str | None, key: str, threshold: float, id_: str = "id") -> DataFrame:
    """(id, leader): in the order of ids of a block, a row joins the first leader whose key is alike, else it
    leads; without a block over all rows. All like pairs of distinct keys are found first; a task then handles a
    component of like keys, as no key of another one can lead it."""
    rows = df.where(filled(F.col(key))).select(F.col(id_).alias("id"), F.col(key).alias("k"), (F.coalesce(F.col(block).cast("string"), F.lit("")) if block else F.lit("")).alias("block"))
    keys = cut(rows.groupBy("k", "block").agg(F.min("id").alias("id")))
    like = cut(like_pairs(keys, threshold).select(F.col("a").alias("u"), F.col("b").alias("v")))

    def run(pdf):
        import pandas as pd

        before: dict[int, list[int]] = {}
        for u, v in zip(pdf["u"], pdf["v"]):
            before.setdefault(v, []).append(u)
        lead: dict[int, int] = {}
        for i in sorted({*pdf["u"], *pdf["v"]}):
            lead[i] = min((u for u in before.get(i, ()) if lead[u] == u), default=i)
        return pd.DataFrame(list(lead.items()), columns=["first", "leader"])

    of = components(like).withColumnRenamed("id", "u")
    led = like.join(of, "u").groupBy(_together("component", like)).applyInPandas(run, "first bigint, leader bigint")
    first = rows.join(keys.select("k", "block", F.col("id").alias("first")), ["k", "block"]).select("id", "first")
    return first.join(led, "first", "left").select("id", F.coalesce("leader", "first").alias("leader"))


def titled_clusters(df: DataFrame, threshold: float, block: list[str], authors: DataFrame | None = None, author_threshold: float = 0.82) -> DataFrame:
    """Clusters of rows of one block (year, leader of the host, chapter number) whose titles are alike and,
    if authors are given, of which a pair of authors is; a row without authors agrees with any.
    df: id, title, block columns; authors: id, name."""
    key = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in block])
    p = like_pairs(cut(df.where(filled(F.col("title"))).select("id", F.col("title").alias("k"), key.alias("block"))), threshold).select("a", "b")
    if authors is not None:
        n = authors.where(filled(F.col("name"))).select("id", "name").distinct()
        both = p.join(n.select(F.col("id").alias("a"), F.col("name").alias("x")), "a").join(n.select(F.col("id").alias("b"), F.col("name").alias("y")), "b")
        agree = similar_pairs(both, "x", "y", author_threshold).select("a", "b").distinct()
        has = n.select("id").distinct()
        free = p.join(has.select(F.col("id").alias("a")), "a", "left_anti").unionAll(p.join(has.select(F.col("id").alias("b")), "b", "left_anti"))
        p = agree.unionAll(free).distinct()
    return cluster_pairs(p)


def titles_match(a: Column, b: Column, threshold: float = 0.85, least: int = 10) -> Column:
    inside = (F.least(F.length(a), F.length(b)) >= least) & (a.contains(b) | b.contains(a))
    return native_at_least(a, b, threshold) | inside


def hosts_part(a: Column, b: Column, ratio: Column, threshold: float = 0.2) -> Column:
    """Both hosts are there and so unlike that they speak against a match."""
    return filled(a) & filled(b) & (ratio < threshold) & ~(a.contains(b) | b.contains(a))


def _inside(df: DataFrame, least: int = 10) -> tuple[DataFrame, DataFrame]:
    """(id, gram) of all stretches of `least` letters of a title, and of the rarest of each: who holds a title as a
    part holds its rarest stretch."""
    n = F.length("title")
    every = df.where(n >= least).select("id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), n - (least - 1)), lambda i: F.substring("title", i, F.lit(least))))).alias("gram"))
    counts = every.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = every.join(counts, "gram").groupBy("id").agg(F.min(F.struct("n", "gram"))["gram"].alias("gram"))
    return every, rarest


def permissive_pairs(df: DataFrame, ratio: Callable[[Column, Column], Column] = native_ratio) -> DataFrame:
    """(a, b): rows with a year and a host against those of the same or the next year; the others - the
    catch-all - against every row that shares a word of its title. Candidates are near by length, letters and pairs of
    letters, or one's rarest stretch is in the other; titles are compared first."""
    df = cut(df.select("id", "year", "title", "host", (F.col("year").isNotNull() & filled(F.col("host"))).alias("main")))
    where = df.select("id", "year", "main", F.length("title").alias("n"))

    def meet(left: DataFrame, right: DataFrame) -> DataFrame:
        x, y = left.join(where, "id").select("gram", F.col("id").alias("p"), "year", "main", F.col("n").alias("np")), right.join(where, "id").select("gram", F.col("id").alias("q"), "year", "main", F.col("n").alias("nq"))
        years = x.where("main").withColumn("year", F.explode(F.array(F.col("year") - 1, F.col("year"), F.col("year") + 1)))
        dated = years.drop("main").join(y.where("main").drop("main"), ["gram", "year"])
        loose = x.where("NOT main").drop("main", "year").join(y.drop("main", "year"), "gram")
        other = x.where("main").drop("main", "year").join(y.where("NOT main").drop("main", "year"), "gram")
        return dated.drop("year").unionByName(loose).unionByName(other).where("np <= nq").where("p <> q").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))

    keys = lambda where, block: df.where(where).select("id", F.col("title").alias("k"), block.alias("block"))
    years = F.explode(F.array(*[(F.col("year") + i).cast("string") for i in (-1, 0, 1)]))
    dated = near_pairs(keys("main", F.col("year").cast("string")), keys("main", years), 0.85, indel=False).where("a < b")
    loose = near_pairs(keys("NOT main", F.lit("")), keys("true", F.lit("")), 0.85, indel=False).where("a <> b")
    near = dated.unionAll(loose).where(native_at_least(F.col("x"), F.col("y"), 0.85)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    every, rarest = _inside(df)
    p = near.unionAll(meet(rarest, every)).distinct()
    side = lambda i, t: df.select(F.col("id").alias(i), *[F.col(c).alias(t + c) for c in ("title", "host", "main")])
    p = p.join(side("a", "x"), "a").join(side("b", "y"), "b").where(titles_match(F.col("xtitle"), F.col("ytitle")))
    main = F.col("xmain") & F.col("ymain")
    words = F.arrays_overlap(F.split("xtitle", " "), F.split("ytitle", " "))
    return p.where(F.when(main, ~hosts_part(F.col("xhost"), F.col("yhost"), ratio(F.col("xhost"), F.col("yhost")))).otherwise(words)).select("a", "b")


def aggressive(df: DataFrame, threshold: float = 0.9) -> DataFrame:
    """(id, kept): rows by length of title (then id); one is dropped where a kept row of its year, or without
    year, has a title alike, and hosts equal where both are given. Dated rows are settled in each year,
    then undated rows among themselves and against the dated ones that were kept. Like titles are found first; a
    task settles a component of them."""
    d = cut(df.where(filled(F.col("title"))).select("id", F.col("title").alias("k"), F.coalesce("host", F.lit("")).alias("h"), F.coalesce(F.col("year").cast("string"), F.lit("")).alias("block")))
    hosts = lambda p: p.join(d.select(F.col("id").alias("a"), F.col("h").alias("ha")), "a").join(d.select(F.col("id").alias("b"), F.col("h").alias("hb")), "b").where("ha = '' OR hb = '' OR ha = hb")
    like = cut(hosts(like_pairs(d, threshold)).select("a", "b", F.length("x").alias("na"), F.length("y").alias("nb")))

    def settle(pdf):
        import pandas as pd

        size, near = {}, {}
        for a, b, x, y in zip(pdf["a"], pdf["b"], pdf["na"], pdf["nb"]):
            size[a], size[b] = x, y
            near.setdefault(a, []).append(b)
            near.setdefault(b, []).append(a)
        kept: dict[int, bool] = {}
        for i in sorted(size, key=lambda i: (size[i], i)):
            kept[i] = not any(kept.get(j, False) for j in near[i])
        return pd.DataFrame(list(kept.items()), columns=["id", "kept"])

    of = components(like.select(F.col("a").alias("u"), F.col("b").alias("v"))).withColumnRenamed("id", "a")
    settled = like.join(of, "a").groupBy(_together("component", like)).applyInPandas(settle, "id bigint, kept boolean")
    first = cut(d.join(settled, "id", "left").select("id", "k", "h", "block", F.coalesce("kept", F.lit(True)).alias("kept")))
    # undated rows against the dated ones that were kept
    stay = first.where("kept")
    loose, dated = (stay.where(w).select("id", "k", F.lit("").alias("block")) for w in ("block = ''", "block <> ''"))
    gone = hosts(like_pairs(loose, threshold, dated).select("a", "b")).select(F.col("a").alias("id")).distinct().withColumn("gone", F.lit(True))
    return first.join(gone, "id", "left").select("id", (F.col("kept") & F.col("gone").isNull()).alias("kept"))


def outside_envelope(low: DataFrame, middle: DataFrame, high: DataFrame, key: str) -> DataFrame:
    """Keys whose counts n aren't in order, missing ones as zero."""
    d = low.select(key, F.col("n").alias("low")).join(middle.select(key, F.col("n").alias("mid")), key, "full").join(high.select(key, F.col("n").alias("high")), key, "full").na.fill(0)
    return d.where("low > mid OR mid > high")


def config_score(chapter: Column, book: Column, chapter_least: float = 0.8, book_least: float = 0.7) -> Column:
    """Score of one way to read a remote record as chapter and book; 0 where either falls short."""
    ok = (chapter >= chapter_least) & (F.coalesce(book, chapter) >= book_least)
    return F.when(ok, 0.7 * chapter + 0.3 * F.coalesce(book, chapter)).otherwise(0.0)


def combined_score(title: Column, host: Column, generic: Column, strict: float = 0.85, least: float = 0.7) -> Column:
    """Mean of the scores that are there; a generic title leaves the host, strictly."""
    mean = F.when(host.isNull(), title).otherwise((title + host) / 2)
    return F.when(generic, F.when(host >= strict, host)).when(mean >= least, mean)


def authority_score(name: Column, title: Column) -> Column:
    s = 0.6 * name + 0.4 * title
    return F.when((name >= 0.65) & (title >= 0.7) & (s >= 0.82), s)


def contained_ratio(a: Column, b: Column, ratio: Column, least: int = 30) -> Column:
    """1 where one of two texts longer than `least` holds the other, else the ratio."""
    return F.when((F.length(a) > least) & (F.length(b) > least) & (a.contains(b) | b.contains(a)), 1.0).otherwise(ratio)


def containment_bonus(a: Column, b: Column, ratio: Column, bonus: float = 0.82) -> Column:
    s, l = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    ws, wl = F.split(s, " "), F.split(l, " ")
    share = F.size(F.filter(ws, lambda w: F.array_contains(wl, w))) / F.size(ws)
    return F.when((F.length(s) < 0.6 * F.length(l)) & l.contains(s) & (share >= 0.8), F.greatest(ratio, F.lit(bonus))).otherwise(ratio)


def cascade(keys: DataFrame, stages: list[DataFrame], key: str) -> DataFrame:
    """(key, stage, match, score) of the first stage that matches a key, and keys without any."""
    found = None
    for i, s in enumerate(stages, 1):
        s = s.withColumn("stage", F.lit(i))
        found = s if found is None else found.unionByName(s)
    best = found.groupBy(key).agg(F.min(F.struct("stage", (-F.col("score")).alias("s"), "match")).alias("b"))
    return keys.select(key).distinct().join(best.select(key, "b.stage", "b.match", (-F.col("b.s")).alias("score")), key, "left")


def two_raters(a: DataFrame, b: DataFrame, key: str, manual: DataFrame | None = None) -> DataFrame:
    """(key, label, source): agreement, conflict (null label) or the manual decision over both."""
    d = a.select(key, F.col("label").alias("x")).join(b.select(key, F.col("label").alias("y")), key, "full")
    label, source = F.when(F.col("x").eqNullSafe(F.col("y")), F.col("x")), F.when(F.col("x").eqNullSafe(F.col("y")), "agreed").otherwise("conflict")
    d = d.select(key, label.alias("label"), source.alias("source"))
    if manual is None:
        return d
    d = d.join(manual.select(key, F.col("label").alias("_m")), key, "left")
    return d.select(key, F.coalesce("_m", "label").alias("label"), F.when(F.col("_m").isNotNull(), "manual").otherwise(F.col("source")).alias("source"))


def find_or_create(names: DataFrame, known: DataFrame, name: str = "name", id_: str = "id") -> DataFrame:
    """(name, id): known ids, and new ones after the largest. New names are numbered in their order over a
    range partitioning, without one task for all."""
    n = names.select(name).where(filled(F.col(name))).distinct().join(known.select(name, id_), name, "left")
    new = n.where(F.col(id_).isNull()).select(name)
    parts = new.repartitionByRange(name).withColumn("_p", F.spark_partition_id())
    top = known.agg(F.coalesce(F.max(id_), F.lit(0)).alias("_top"))
    sizes = parts.groupBy("_p").agg(F.count("*").alias("_n")).withColumn("_b", F.sum("_n").over(Window.orderBy("_p")) - F.col("_n"))  # one row for each partition
    made = parts.join(F.broadcast(sizes), "_p").crossJoin(F.broadcast(top)).select(name, (F.col("_top") + F.col("_b") + F.row_number().over(Window.partitionBy("_p").orderBy(name))).cast("bigint").alias(id_))
    return n.where(F.col(id_).isNotNull()).select(name, id_).unionByName(made)
