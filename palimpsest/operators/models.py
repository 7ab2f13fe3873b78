"""Topic models and small optimisation problems.

Series and matrices of a few hundred points (years, groups, topics) are solved in a grouped-map task; what
grows with the corpus stays in Spark's own estimators and aggregates.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def natural_breaks(values: list[float], k: int) -> list[int]:
    """Last index of each of k classes of sorted values with the least squared deviation."""
    n = len(values)
    k = max(1, min(k, n))
    s, q = [0.0], [0.0]
    for v in values:
        s.append(s[-1] + v)
        q.append(q[-1] + v * v)
    cost = lambda i, j: (q[j + 1] - q[i]) - (s[j + 1] - s[i]) ** 2 / (j - i + 1)
    best = [[cost(0, j) for j in range(n)]]
    cut: list[list[int]] = [[0] * n]
    for _ in range(1, k):
        row, at = [math.inf] * n, [0] * n
        for j in range(len(best), n):
            for i in range(len(best), j + 1):
                c = best[-1][i - 1] + cost(i, j)
                if c < row[j] - 1e-12:
                    row[j], at[j] = c, i
        best.append(row)
        cut.append(at)
    ends, j = [], n - 1
    for level in range(k - 1, -1, -1):
        ends.append(j)
        j = cut[level][j] - 1
    return ends[::-1]


def change_points(values: list[float], penalty: float = 15.0, least: int = 3) -> list[int]:
    """First index of each new segment under a normal cost of mean and variance, pruned exact search."""
    n = len(values)
    s, q = [0.0], [0.0]
    for v in values:
        s.append(s[-1] + v)
        q.append(q[-1] + v * v)

    def cost(i: int, j: int) -> float:
        m = j - i
        return m * math.log(max((q[j] - q[i]) / m - ((s[j] - s[i]) / m) ** 2, 1e-8))

    f, back, candidates = [-penalty] + [math.inf] * n, [0] * (n + 1), [0]
    for t in range(least, n + 1):
        options = [(f[c] + cost(c, t) + penalty, c) for c in candidates if t - c >= least and f[c] < math.inf]
        if not options:
            continue
        f[t], back[t] = min(options)
        candidates = [c for c in candidates if t - c < least or f[c] + cost(c, t) <= f[t]] + [t - least + 1]
    out, t = [], n
    while t > 0:
        t = back[t]
        if t > 0:
            out.append(t)
    return out[::-1]


def ward_labels(points, k: int) -> list[int]:
    """Labels of Ward's agglomerative clustering with k clusters, in the order of first members."""
    import numpy as np

    x = np.asarray(points, float)
    size = {i: 1 for i in range(len(x))}
    centre = {i: x[i] for i in range(len(x))}
    member = {i: [i] for i in range(len(x))}
    while len(centre) > max(1, k):
        keys = list(centre)
        c = np.stack([centre[i] for i in keys])
        n = np.array([size[i] for i in keys], float)
        d = ((c[:, None, :] - c[None, :, :]) ** 2).sum(-1) * (n[:, None] * n[None, :] / (n[:, None] + n[None, :]))
        d[np.tril_indices(len(keys))] = np.inf
        a, b = np.unravel_index(int(d.argmin()), d.shape)
        i, j = keys[a], keys[b]
        centre[i] = (size[i] * centre[i] + size[j] * centre[j]) / (size[i] + size[j])
        size[i] += size[j]
        member[i] += member[j]
        for m in (centre, size, member):
            del m[j]
    label = [0] * len(x)
    for n_, i in enumerate(sorted(member, key=lambda i: min(member[i]))):
        for m in member[i]:
            label[m] = n_
    return label


def jenks_periods(counts: DataFrame, year: str, n: str, k: int | None = None) -> DataFrame:
    """(period, first, last) of years by natural breaks of cumulated counts; the number of classes by Sturges'
    rule. One row for each year is what a task sees."""
    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values("y")
        y, v = pdf["y"].tolist(), pdf["n"].cumsum().astype(float).tolist()
        m = k or max(2, round(1 + 3.22 * math.log10(max(1, len(v)))))
        out, a = [], 0
        for i, b in enumerate(natural_breaks(v, m)):
            out.append((i, y[a], y[b]))
            a = b + 1
        return pd.DataFrame(out, columns=["period", "first", "last"])

    per = counts.groupBy(F.col(year).cast("int").alias("y")).agg(F.sum(n).cast("double").alias("n")).where("y IS NOT NULL")
    return per.groupBy().applyInPandas(run, "period int, first int, last int")


def breaks(series: DataFrame, group: str, order: str, value: str, penalty: float = 15.0) -> DataFrame:
    """(group, order) at which a series changes. A series has one row for each year."""
    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values("o")
        return pd.DataFrame([(pdf["g"].iloc[0], int(pdf["o"].iloc[i])) for i in change_points(pdf["v"].astype(float).tolist(), penalty)], columns=["g", "o"])

    d = series.select(F.col(group).cast("string").alias("g"), F.col(order).cast("int").alias("o"), F.col(value).alias("v"))
    return d.groupBy("g").applyInPandas(run, "g string, o int").toDF(group, order)


def ward(centroids: DataFrame, key: str, vector: str, k: int, limit: int = 4000) -> DataFrame:
    """(key, cluster) of at most `limit` points: distances between all of them are needed, so that larger sets
    are reduced to centroids first (for example by k-means)."""
    if centroids.count() > limit:
        raise ValueError(f"Ward clustering takes at most {limit} points; cluster centroids instead")

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values("k")
        return pd.DataFrame({"k": pdf["k"], "cluster": ward_labels(list(pdf["v"]), k)})

    return centroids.select(F.col(key).cast("bigint").alias("k"), F.transform(vector, lambda x: x.cast("double")).alias("v")).groupBy().applyInPandas(run, "k bigint, cluster int").withColumnRenamed("k", key)


def lda(docs: DataFrame, key: str, terms: str, k: int, seed: int = 1826, passes: int = 20, least: int = 2, size: int = 1 << 16):
    """(model, vocabulary, gamma: key, gamma array): online variational Bayes over document-term counts. A pass
    is an iteration over as many documents as there are, with the reference's (gensim's) offset 1 and decay 0.5.
    Spark draws them with replacement: a pass has each document once on average, and of 20 passes one in 10^8
    or fewer is never drawn."""
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import CountVectorizer
    from pyspark.ml.functions import vector_to_array

    cv = CountVectorizer(inputCol=terms, outputCol="features", minDF=least, vocabSize=size).fit(docs)
    dtm = cut(cv.transform(docs).select(key, "features"))  # read in every pass
    model = LDA(k=k, seed=seed, maxIter=passes, optimizer="online", subsamplingRate=1.0, learningOffset=1.0, learningDecay=0.5).fit(dtm)
    gamma = model.transform(dtm).select(key, vector_to_array("topicDistribution").alias("gamma"))
    return model, cv.vocabulary, gamma


def topic_words(model, vocabulary: list[str], top: int = 20) -> DataFrame:
    """(topic, rank, term, beta)."""
    t = model.describeTopics(top)
    words = F.array(*[F.lit(w) for w in vocabulary]) if len(vocabulary) <= 500 else None
    d = t.select("topic", F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("rank", "t"))
    if words is not None:
        return d.select("topic", (F.col("rank") + 1).alias("rank"), F.get(words, F.col("t.termIndices")).alias("term"), F.col("t.termWeights").alias("beta"))
    names = t.sparkSession.createDataFrame(list(enumerate(vocabulary)), "i int, term string")
    return d.join(names, F.col("t.termIndices") == F.col("i")).select("topic", (F.col("rank") + 1).alias("rank"), "term", F.col("t.termWeights").alias("beta"))


def coherence(df: DataFrame, doc: str, topics: DataFrame, window: int = 110, token: str = "token") -> DataFrame:
    """(topic, c_v): mean cosine of each top word's vector of normalised pointwise mutual information with the
    sum of the topic's vectors, over boolean sliding windows. topics: topic, term. Windows start at every
    token; documents shorter than a window are one. A word in every window goes with itself wholly (1) and with
    others as chance has it (0). Only tokens of topics are kept before windows are built."""
    wanted = F.broadcast(topics.select(F.col("term").alias(token)).distinct())  # topics x top words
    length = df.groupBy(doc).agg(F.max("at").alias("last"))
    hits = df.join(wanted, token).select(doc, token, "at").join(length, doc)
    first, final = F.greatest(F.lit(0), F.col("at") - (window - 1)), F.greatest(F.lit(0), F.least(F.col("at"), F.col("last") - (window - 1)))
    inside = hits.select(doc, token, F.explode(F.sequence(F.least(first, final), final)).alias("w")).distinct()
    total = length.agg(F.sum(F.greatest(F.lit(1), F.col("last") - window + 2)).alias("N"))
    single = inside.groupBy(token).agg(F.count("*").alias("n"))
    pair = inside.select(doc, "w", F.col(token).alias("a")).join(inside.select(doc, "w", F.col(token).alias("b")), [doc, "w"]).groupBy("a", "b").agg(F.count("*").alias("nab"))
    t = topics.select("topic", F.col("term").alias("a")).join(topics.select("topic", F.col("term").alias("b")), "topic")
    t = t.join(pair, ["a", "b"], "left").join(single.select(F.col(token).alias("a"), F.col("n").alias("na")), "a", "left").join(single.select(F.col(token).alias("b"), F.col("n").alias("nb")), "b", "left").crossJoin(F.broadcast(total))  # one row
    e = 1e-12
    p = F.coalesce("nab", F.lit(0)) / F.col("N")
    npmi = F.when(F.col("a") == F.col("b"), 1.0).otherwise(F.try_divide(F.log((p + e) / (F.col("na") / F.col("N") * F.col("nb") / F.col("N") + e)), -F.log(p + e)))
    v = t.select("topic", "a", "b", F.coalesce(npmi, F.lit(0.0)).alias("x"))
    s = v.groupBy("topic", "b").agg(F.sum("x").alias("y"))
    c = v.join(s, ["topic", "b"]).groupBy("topic", "a").agg(F.try_divide(F.sum(F.col("x") * F.col("y")), F.sqrt(F.sum(F.col("x") * F.col("x")) * F.sum(F.col("y") * F.col("y")))).alias("c"))
    return c.groupBy("topic").agg(F.avg("c").alias("c_v"))


def reduce_dimensions(df: DataFrame, key: str, vector: str, k: int = 5) -> DataFrame:
    """(key, reduced): principal components, which stand in for a neighbour embedding."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    d = df.select(key, array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("v"))
    return PCA(k=k, inputCol="v", outputCol="r").fit(d).transform(d).select(key, vector_to_array("r").alias("reduced"))


def yearly_presence(gamma: DataFrame, year: str, threshold: float = 0.15) -> DataFrame:
    """(year, topic, docs, mean): documents a topic is present in, and its mean share."""
    d = gamma.select(year, F.posexplode("gamma").alias("topic", "g"))
    return d.groupBy(year, "topic").agg(F.sum((F.col("g") >= threshold).cast("int")).alias("docs"), F.avg("g").alias("mean"))


def top_documents(gamma: DataFrame, key: str, k: int = 10) -> DataFrame:
    """(topic, rank, key, gamma)."""
    d = gamma.select(key, F.posexplode("gamma").alias("topic", "g"))
    return d.withColumn("rank", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("g"), key))).where(F.col("rank") <= k)
