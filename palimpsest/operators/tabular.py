"""Relational operators of time-series bibliometrics and record keeping, as DataFrame plans.

Ties are always broken by an explicit key. Nulls in a key column form a group of their own unless a
docstring says otherwise; an empty input gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identifiers import SENTINELS
from ..session import cut


def conform(df: DataFrame, schema: dict[str, str], required: tuple[str, ...] = ()) -> DataFrame:
    """Columns of a table read as text, in their types: names trimmed and in lower case, sentinels null,
    values that don't parse null. A required column that is missing is an error."""
    df = df.toDF(*[c.lstrip("﻿").strip().lower() for c in df.columns])
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*[(blank_to_null(F.col(c)).try_cast(t) if c in df.columns else F.lit(None).cast(t)).alias(c) for c, t in schema.items()])


def blank_to_null(c: Column, sentinels: tuple[str, ...] = SENTINELS) -> Column:
    t = F.trim(c)
    return F.when(~F.lower(t).isin(*sentinels), t)


def filled(c: Column) -> Column:
    return F.coalesce(F.trim(c.cast("string")), F.lit("")) != ""


def any_filled(*cols: str) -> Column:
    return reduce(lambda a, b: a | b, [filled(F.col(c)) for c in cols])


def fill_if_empty(c: Column, value: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(c), F.lit("")), value)


def changed(df: DataFrame, updates: dict[str, Column]) -> DataFrame:
    """df with the updated columns, and `changed`: the names of those that differ."""
    names = F.filter(F.array(*[F.when(~F.col(c).eqNullSafe(v), F.lit(c)) for c, v in updates.items()]), lambda x: x.isNotNull())
    return df.withColumn("changed", names).withColumns(updates)


def top_labels(df: DataFrame, label: str, n: int) -> DataFrame:
    """The n most frequent labels, ties by label."""
    return df.groupBy(label).agg(F.count("*").alias("n")).orderBy(F.desc("n"), label).limit(n).select(label)


def other_bucket(df: DataFrame, label: str, n: int, other: str = "Other") -> DataFrame:
    """df with labels outside the n most frequent replaced. At most n labels are broadcast."""
    top = F.broadcast(top_labels(df, label, n).withColumn("_top", F.lit(True)))
    return df.join(top, label, "left").withColumn(label, F.when(F.col("_top"), F.col(label)).otherwise(F.lit(other))).drop("_top")


def complete(counts: DataFrame, keys: dict[str, DataFrame], value: str = "n", fill=0) -> DataFrame:
    """One row for each combination of the keys' values, with `fill` where counts has none. The keys are
    short lists (years, top labels): their product is the result, not an intermediate."""
    grid = reduce(lambda a, b: a.crossJoin(b), [d.select(k).distinct() for k, d in keys.items()])
    return grid.join(counts, list(keys), "left").na.fill({value: fill})


def calendar(df: DataFrame, year: str) -> DataFrame:
    """All years from the first to the last."""
    span = df.agg(F.min(year).alias("a"), F.max(year).alias("b")).where("a IS NOT NULL")
    return span.select(F.explode(F.sequence("a", "b")).alias(year))


def share_of(value: str, *within: str) -> Column:
    return F.col(value) / F.sum(value).over(Window.partitionBy(*within))


def centred_average(value: str, width: int, order: str, *within: str) -> Column:
    """Mean over width rows around each, null where the window isn't full."""
    w = Window.partitionBy(*within).orderBy(order).rowsBetween(-(width // 2), width // 2)
    return F.when(F.count(value).over(w) == width, F.avg(value).over(w))


def running_sum(value: str, order: str, *within: str) -> Column:
    return F.sum(value).over(Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def fractional(df: DataFrame, unit: str, label: str) -> DataFrame:
    """(label, weight): every unit spreads a weight of one over its distinct labels."""
    d = df.select(unit, label).distinct()
    n = d.groupBy(unit).agg(F.count("*").alias("_n"))
    return d.join(n, unit).groupBy(label).agg(F.sum(F.lit(1.0) / F.col("_n")).alias("weight"))


def rank_slice(counts: DataFrame, label: str, first: int, last: int, value: str = "n") -> DataFrame:
    """Rows of rank first to last by falling value. It reads only the top `last` rows of each task."""
    top = counts.orderBy(F.desc(value), label).limit(last)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(value), label))).where(F.col("rank") >= first)


def top_k(df: DataFrame, k: int, order: list[Column], *within: str) -> DataFrame:
    """The first k rows of each group, with their rank; Spark keeps k rows a group before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*within).orderBy(*order))).where(F.col("rank") <= k)


def decade(year: Column) -> Column:
    return F.concat((F.floor(year / 10) * 10).cast("int").cast("string"), F.lit("s"))


def first_filled(order: str, *cols: str) -> list[Column]:
    """Aggregates: each column's value in the first row, by order, where it isn't null."""
    return [F.min(F.when(F.col(c).isNotNull(), F.struct(order, c)))[c].alias(c) for c in cols]


def last_filled(order: str, *cols: str) -> list[Column]:
    return [F.max(F.when(F.col(c).isNotNull(), F.struct(order, c)))[c].alias(c) for c in cols]


def priority_pick(sources: list[DataFrame], key: str) -> DataFrame:
    """One row for each key, from the first source that has it, with the source's number."""
    union = reduce(lambda a, b: a.unionByName(b), [s.withColumn("priority", F.lit(i)) for i, s in enumerate(sources, 1)])
    cols = [c for c in union.columns if c not in (key, "priority")]
    best = union.groupBy(key).agg(F.min(F.struct("priority", *cols)).alias("b"))
    return best.select(key, "b.priority", *[F.col("b")[c].alias(c) for c in cols])


def best_match(pairs: DataFrame, left: str, score: str, order: str) -> DataFrame:
    """Each left row's pair of the largest score, the first by order among equals."""
    cols = [c for c in pairs.columns if c not in (left, score, order)]
    best = pairs.groupBy(left).agg(F.min(F.struct(-F.col(score), order, *cols)).alias("b"))
    return best.select(left, (-F.col("b.col1")).alias(score), F.col("b")[order].alias(order), *[F.col("b")[c].alias(c) for c in cols])


def band_pairs(df: DataFrame, key: str, number: str, reach: int, *equal: str) -> DataFrame:
    """(a, b) pairs of rows whose number differs by at most `reach`, as an equi-join on exploded numbers."""
    a = df.select(F.col(key).alias("a"), F.col(number).alias("x"), *equal)
    b = df.select(F.col(key).alias("b"), F.explode(F.sequence(F.col(number) - reach, F.col(number) + reach)).alias("x"), *equal)
    return a.join(b, ["x", *equal]).where("a < b").select("a", "b")


def explode_keys(df: DataFrame, key: str, *fields: str, split: str = "[;,]") -> DataFrame:
    """(key, k): normalised values of several list-valued string fields."""
    parts = F.flatten(F.array(*[F.coalesce(F.split(c, split), F.array().cast("array<string>")) for c in fields]))
    return df.select(key, F.explode(F.transform(parts, lambda x: F.lower(F.regexp_replace(x, r"[\s\-]", "")))).alias("k")).where("k <> ''").distinct()


SIDE = 8_000  # rows of either side that a task compares


def shared_tokens(left: DataFrame, right: DataFrame, least: int = 2) -> DataFrame:
    """(a, b, shared) of rows with at least so many tokens in common. left: a, token; right: b, token. The tokens go to
    tiles of bounded numbers of rows and are counted there: pairs are never shuffled."""
    left, right = cut(left.where("a IS NOT NULL AND token IS NOT NULL").distinct()), cut(right.where("b IS NOT NULL AND token IS NOT NULL").distinct())
    n, m = (d.select(c).distinct().count() // SIDE + 1 for d, c in ((left, "a"), (right, "b")))
    n = max(n, -(-4 * left.sparkSession.sparkContext.defaultParallelism // m))  # some tiles for every core
    i, j = F.pmod(F.xxhash64("a"), F.lit(n)), F.pmod(F.xxhash64("b"), F.lit(m))
    x = left.select("a", "token", F.explode(F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda k: i * m + k)).alias("tile"))
    y = right.select("b", "token", F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: k * m + j)).alias("tile"))
    kinds = dict(x.dtypes) | dict(y.dtypes)

    def run(l, r):
        import numpy as np
        import pandas as pd

        l, r = l[l["token"].isin(r["token"].unique())], r[r["token"].isin(l["token"].unique())]
        code, tokens = pd.factorize(r["token"])
        b, bs = pd.factorize(r["b"])
        b = b[np.argsort(code, kind="stable")]
        ends = np.cumsum(np.bincount(code, minlength=len(tokens)))
        rows = np.split(b, ends[:-1]) if len(ends) else []
        own = pd.Index(tokens).get_indexer(l["token"])
        a, as_ = pd.factorize(l["a"])
        order = np.argsort(a, kind="stable")
        mine = np.split(own[order], np.cumsum(np.bincount(a))[:-1]) if len(a) else []
        ids, met, counts = [], [], []
        for k, tokens_of in enumerate(mine):
            if len(tokens_of) >= least:
                c = np.bincount(np.concatenate([rows[t] for t in tokens_of]))
                near = np.flatnonzero(c >= least)
                ids.append(np.full(len(near), k))
                met.append(near)
                counts.append(c[near])
        if not ids:
            return pd.DataFrame({"a": as_[:0], "b": bs[:0], "shared": np.zeros(0, np.int64)})
        return pd.DataFrame({"a": np.asarray(as_)[np.concatenate(ids)], "b": np.asarray(bs)[np.concatenate(met)], "shared": np.concatenate(counts)})

    return x.groupBy("tile").cogroup(y.groupBy("tile")).applyInPandas(run, f"a {kinds['a']}, b {kinds['b']}, shared bigint")


def block_pairs(df: DataFrame, key: str, block: str, *keep: str) -> DataFrame:
    """Pairs a < b of rows of one block, with the columns to compare as x_ and y_."""
    a = df.select(block, F.col(key).alias("a"), *[F.col(c).alias(f"x_{c}") for c in keep])
    b = df.select(block, F.col(key).alias("b"), *[F.col(c).alias(f"y_{c}") for c in keep])
    return a.join(b, block).where("a < b")


def full_outer(frames: list[DataFrame], key: str, fill=0) -> DataFrame:
    return reduce(lambda a, b: a.join(b, key, "full"), frames).na.fill(fill)


def box_plot(value: str) -> list[Column]:
    """Aggregates: n, mean, least, quartiles and largest, by linear interpolation."""
    q = lambda p: F.percentile(value, F.lit(p))
    return [F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("least"), q(0.25).alias("q1"), q(0.5).alias("median"), q(0.75).alias("q3"), F.max(value).alias("largest")]


def frequency_bucket(n: Column) -> Column:
    edges = [(1, "1"), (4, "2-4"), (9, "5-9"), (19, "10-19"), (49, "20-49")]
    return F.coalesce(*[F.when(n <= hi, label) for hi, label in edges], F.lit("50+"))


def hash_split(key: Column, parts: int = 4) -> Column:
    """A stable part number of a key, the same on every run and size."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(parts))


def sturges(n: Column) -> Column:
    return F.greatest(F.lit(2), F.round(1 + 3.22 * F.log10(n)).cast("int"))


def upper_triangle(matrix: DataFrame, names: list[str]) -> DataFrame:
    """(a, b, value) of a one-row frame with columns a__b."""
    return matrix.unpivot([], [f"{a}__{b}" for i, a in enumerate(names) for b in names[i + 1 :]], "pair", "value").select(F.split_part("pair", F.lit("__"), F.lit(1)).alias("a"), F.split_part("pair", F.lit("__"), F.lit(2)).alias("b"), "value")
