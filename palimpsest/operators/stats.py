"""Statistical tests and indices from sums and windows."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import chi2_p, normal_p, student_p


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n, expected) of all combinations, with the margins."""
    n = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("n"))
    grid = n.select(a).distinct().crossJoin(n.select(b).distinct())  # categories, not rows
    t = grid.join(n, [a, b], "left").na.fill(0, ["n"])
    row, col, every = Window.partitionBy(a), Window.partitionBy(b), Window.partitionBy()
    t = t.withColumns({"row": F.sum("n").over(row), "col": F.sum("n").over(col), "total": F.sum("n").over(every)})
    return t.withColumn("expected", F.col("row") * F.col("col") / F.col("total"))


def residuals(table: DataFrame) -> DataFrame:
    """Pearson and adjusted residuals, share of chi-squared, two-sided p and status at 1.96."""
    t = table.withColumn("pearson", (F.col("n") - F.col("expected")) / F.sqrt("expected"))
    t = t.withColumn("adjusted", (F.col("n") - F.col("expected")) / F.sqrt(F.col("expected") * (1 - F.col("row") / F.col("total")) * (1 - F.col("col") / F.col("total"))))
    share = 100 * F.col("pearson") * F.col("pearson") / F.sum(F.col("pearson") * F.col("pearson")).over(Window.partitionBy())
    status = F.when(F.col("adjusted") > 1.96, "over").when(F.col("adjusted") < -1.96, "under").otherwise("ns")
    return t.withColumn("share", share).withColumn("status", status)


def with_normal_p(df: DataFrame, z: str = "adjusted") -> DataFrame:
    return df.withColumn("p", normal_p(F.col(z)))


def chi_squared(table: DataFrame, a: str, b: str, p: bool = True) -> DataFrame:
    """One row: chi2, dof, cramers_v (and p). With one degree of freedom the continuity correction applies."""
    diff = F.abs(F.col("n") - F.col("expected"))
    k = table.agg(F.count_distinct(a).alias("r"), F.count_distinct(b).alias("c"), F.first("total").alias("total"), F.sum(diff * diff / F.col("expected")).alias("plain"),
                  F.sum(F.pow(diff - F.least(F.lit(0.5), diff), 2) / F.col("expected")).alias("corrected"))
    dof = (F.col("r") - 1) * (F.col("c") - 1)
    chi = F.when(dof == 1, F.col("corrected")).otherwise(F.col("plain"))
    out = k.select(chi.alias("chi2"), dof.alias("dof"), F.sqrt(chi / (F.col("total") * (F.least("r", "c") - 1))).alias("cramers_v"))
    return out.withColumn("p", chi2_p(F.col("chi2"), F.col("dof"))) if p else out


def average_rank(value: str, *within: str) -> Column:
    """Rank with ties averaged. Partition it, or rank distinct values first: see mid_ranks."""
    w = Window.partitionBy(*within)
    return F.rank().over(w.orderBy(value)) + (F.count("*").over(w.partitionBy(*within, value)) - 1) / 2


def mid_ranks(df: DataFrame, value: str) -> DataFrame:
    """(value, n, mid): each distinct value, its frequency and averaged rank. Ranks come from a range
    partitioning of the distinct values and the sizes of its parts, so that no task sees all rows."""
    c = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))
    c = c.repartitionByRange(value).withColumn("_p", F.spark_partition_id())
    w = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    before = c.groupBy("_p").agg(F.sum("n").alias("m")).withColumn("before", F.coalesce(F.sum("m").over(w), F.lit(0))).select("_p", "before")
    upto = F.sum("n").over(Window.partitionBy("_p").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    return c.join(F.broadcast(before), "_p").select(value, "n", (F.col("before") + upto - (F.col("n") - 1) / 2).alias("mid"))


def kruskal(df: DataFrame, group: str, value: str, least: int = 5, p: bool = True) -> DataFrame:
    """One row: h (corrected for ties), groups, n, epsilon2 (and p), over groups of at least `least` values."""
    d = df.where(F.col(group).isNotNull() & F.col(value).isNotNull()).select(group, value)
    big = d.groupBy(group).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(group)
    d = d.join(F.broadcast(big), group)  # one row for each group
    ranks = mid_ranks(d, value)
    ties = ranks.agg(F.sum(F.pow("n", F.lit(3)) - F.col("n")).alias("ties"))
    g = d.join(ranks.select(value, "mid"), value).groupBy(group).agg(F.sum("mid").alias("r"), F.count("*").alias("k"))
    s = g.agg(F.sum(F.col("r") * F.col("r") / F.col("k")).alias("s"), F.sum("k").alias("n"), F.count("*").alias("groups")).crossJoin(ties)  # one row each
    n = F.col("n")
    h = (12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1)) / (1 - F.col("ties") / (F.pow(n, F.lit(3)) - n))
    out = s.select(h.alias("h"), "groups", "n").withColumn("epsilon2", F.col("h") / (F.col("n") - 1))
    return out.withColumn("p", chi2_p(F.col("h"), F.col("groups") - 1)) if p else out


def spearman(df: DataFrame, columns: list[str], least: int = 5, p: bool = True) -> DataFrame:
    """(a, b, n, rho): every pair of columns, rows with both."""
    out = None
    for a, b in combinations(columns, 2):
        d = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b)
        d = d.join(mid_ranks(d, a).select(a, F.col("mid").alias("_x")), a).join(mid_ranks(d, b).select(b, F.col("mid").alias("_y")), b)
        r = d.agg(F.count("*").alias("n"), F.corr("_x", "_y").alias("rho")).select(F.lit(a).alias("a"), F.lit(b).alias("b"), "n", F.when(F.col("n") >= least, F.col("rho")).alias("rho"))
        out = r if out is None else out.unionAll(r)
    if p:
        t = F.col("rho") * F.sqrt((F.col("n") - 2) / (1 - F.col("rho") * F.col("rho")))
        out = out.withColumn("p", F.when(F.abs("rho") == 1, 0.0).otherwise(student_p(t, F.col("n") - 2)))
    return out


def pearson_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r) of the upper triangle, one pass."""
    pairs = list(combinations(columns, 2))
    row = df.agg(*[F.corr(a, b).alias(f"{a}__{b}") for a, b in pairs])
    return row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}__{b}").alias("r")) for a, b in pairs])).alias("p")).select("p.*")


def gini(df: DataFrame, value: str, zeros: bool = False) -> DataFrame:
    """One row: n, gini of positive values, or of values from zero on; null where the sum is zero."""
    d = df.where(F.col(value) >= 0 if zeros else F.col(value) > 0).select(F.col(value).cast("double").alias("x"))
    r = mid_ranks(d, "x")
    s = r.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("x")).alias("s"), F.sum(F.col("mid") * F.col("n") * F.col("x")).alias("w"))
    return s.select("n", F.when(F.col("s") > 0, 2 * F.col("w") / (F.col("n") * F.col("s")) - (F.col("n") + 1) / F.col("n")).alias("gini"))


def lorenz(df: DataFrame, value: str, points: int = 10) -> DataFrame:
    """(part, share): what the lowest part/points of the positive values hold of the sum."""
    d = df.where(F.col(value) > 0).select(F.col(value).cast("double").alias("x"))
    r = mid_ranks(d, "x").withColumn("last", F.col("mid") + (F.col("n") - 1) / 2)
    s = r.agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.col("x")).alias("sum"))
    cut = s.select("total", "sum", F.explode(F.sequence(F.lit(1), F.lit(points))).alias("part")).withColumn("rank", F.floor(F.col("part") * F.col("total") / points))
    inside = F.greatest(F.lit(0), F.least(F.col("n"), F.col("rank") - (F.col("last") - F.col("n"))))
    return r.crossJoin(F.broadcast(cut)).groupBy("part").agg((F.sum(inside * F.col("x")) / F.first("sum")).alias("share"))  # `points` rows are broadcast


def entropy(counts: DataFrame, row: str, n: str, k: int) -> DataFrame:
    """(row, entropy) of each row's distribution, as a share of ln k."""
    t = counts.groupBy(row).agg(F.sum(n).alias("_t"))
    p = F.col(n) / F.col("_t")
    return counts.where(F.col(n) > 0).join(t, row).groupBy(row).agg((F.sum(-p * F.log(p)) / F.log(F.lit(float(k)))).alias("entropy"))


def mean_vectors(df: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, dim, mean, n): component means, summed in the JVM before the shuffle."""
    return df.select(group, F.posexplode(vector).alias("dim", "x")).groupBy(group, "dim").agg(F.avg("x").alias("mean"), F.count("*").alias("n"))


def cosine_pairs(means: DataFrame, group: str) -> DataFrame:
    """(a, b, cosine) of groups' mean vectors."""
    x, y = means.select(F.col(group).alias("a"), "dim", F.col("mean").alias("x")), means.select(F.col(group).alias("b"), "dim", F.col("mean").alias("y"))
    return x.join(y, "dim").where("a < b").groupBy("a", "b").agg((F.sum(F.col("x") * F.col("y")) / F.sqrt(F.sum(F.col("x") * F.col("x")) * F.sum(F.col("y") * F.col("y")))).alias("cosine"))


def jaccard_pairs(sets: DataFrame, group: str, element: str) -> DataFrame:
    """(a, b, shared, jaccard) of sets that share an element."""
    d = sets.select(group, element).distinct()
    n = d.groupBy(group).agg(F.count("*").alias("n"))
    s = d.select(F.col(group).alias("a"), element).join(d.select(F.col(group).alias("b"), element), element).where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    s = s.join(n.select(F.col(group).alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col(group).alias("b"), F.col("n").alias("nb")), "b")
    return s.select("a", "b", "shared", (F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).alias("jaccard"))


def cluster_indices(df: DataFrame, label: str, vector: str) -> DataFrame:
    """One row: calinski_harabasz, davies_bouldin, by centroids."""
    means = mean_vectors(df, label, vector)
    e = df.withColumn("_id", F.monotonically_increasing_id()).select("_id", label, F.posexplode(vector).alias("dim", "x"))
    dist = e.join(F.broadcast(means), [label, "dim"]).groupBy("_id", label).agg(F.sum(F.pow(F.col("x") - F.col("mean"), 2)).alias("d2"))  # labels x dimensions rows
    per = dist.groupBy(label).agg(F.sum("d2").alias("w"), F.avg(F.sqrt("d2")).alias("s"), F.count("*").alias("n"))
    whole = df.select(F.posexplode(vector).alias("dim", "x")).groupBy("dim").agg(F.avg("x").alias("g"))
    between = means.join(whole, "dim").groupBy(label).agg(F.sum(F.col("n") * F.pow(F.col("mean") - F.col("g"), 2)).alias("b"))
    ch = per.join(between, label).agg(F.sum("b").alias("b"), F.sum("w").alias("w"), F.sum("n").alias("n"), F.count("*").alias("k")).select((F.col("b") / (F.col("k") - 1) / (F.col("w") / (F.col("n") - F.col("k")))).alias("calinski_harabasz"))
    x, y = means.select(F.col(label).alias("a"), "dim", F.col("mean").alias("x")), means.select(F.col(label).alias("b"), "dim", F.col("mean").alias("y"))
    far = x.join(y, "dim").where("a <> b").groupBy("a", "b").agg(F.sqrt(F.sum(F.pow(F.col("x") - F.col("y"), 2))).alias("d"))
    far = far.join(per.select(F.col(label).alias("a"), F.col("s").alias("sa")), "a").join(per.select(F.col(label).alias("b"), F.col("s").alias("sb")), "b")
    db = far.groupBy("a").agg(F.max((F.col("sa") + F.col("sb")) / F.col("d")).alias("r")).agg(F.avg("r").alias("davies_bouldin"))
    return ch.crossJoin(db)  # one row each


def silhouette(df: DataFrame, label: str, vector: str) -> DataFrame:
    """One row: the mean silhouette by squared Euclidean distance, which per-cluster sums give in one pass
    (`pyspark.ml` computes the same)."""
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    d = df.select(F.col(label).cast("double").alias("prediction"), array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("features"))
    s = ClusteringEvaluator(predictionCol="prediction", featuresCol="features", metricName="silhouette").evaluate(d)
    return df.sparkSession.createDataFrame([(s,)], "silhouette double")


def rank_sum(df: DataFrame, key: str, larger: list[str], smaller: list[str]) -> DataFrame:
    """(key, rank_sum): sum of averaged ranks over the criteria, the least is the best. df: one row for each candidate."""
    r = None
    for c in [*larger, *smaller]:
        x = (-F.col(c) if c in larger else F.col(c)).alias("_v")
        d = df.select(key, x)
        w = Window.partitionBy().orderBy("_v")
        one = d.select(key, (F.rank().over(w) + (F.count("*").over(Window.partitionBy("_v")) - 1) / 2).alias("r"))
        r = one if r is None else r.unionAll(one)
    return r.groupBy(key).agg(F.sum("r").alias("rank_sum"))
