"""Bipartite projections, components and centralities.

Edges are frames with columns u < v of bigint (and weight). Isolated vertices come in by a frame of
vertices. Iterations cut their lineage in the shared checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, discard


def project(links: DataFrame, keep: str, over: str, newman: bool = False) -> DataFrame:
    """(u, v, weight): shared partners, or their sum of 1/(k-1) over partners of degree k > 1."""
    d = links.select(F.col(keep).alias("x"), F.col(over).alias("o")).where("x IS NOT NULL AND o IS NOT NULL").distinct()
    if newman:
        d = d.join(d.groupBy("o").agg(F.count("*").alias("k")).where("k > 1"), "o")
        w = F.sum(F.lit(1.0) / (F.col("k") - 1))
    else:
        d, w = d.withColumn("k", F.lit(1)), F.count("*")
    return d.select("o", "k", F.col("x").alias("u")).join(d.select("o", F.col("x").alias("v")), "o").where("u < v").groupBy("u", "v").agg(w.alias("weight"))


def both_ways(edges: DataFrame) -> DataFrame:
    cols = [c for c in edges.columns if c not in ("u", "v")]
    return edges.select("u", "v", *cols).unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), *cols))


ONE = 4_000_000  # edges that one task holds, 64 MB, and some times as much while it works


def _least(a, b, n: int):
    """The smallest vertex of the component of each of n vertices. Of an edge between two labels the larger one takes
    the smaller, until no edge is left between two."""
    import numpy as np

    at = np.arange(n)
    while True:
        x, y = at[a], at[b]
        live = x != y
        if not live.any():
            return at
        a, b = np.minimum(x, y)[live], np.maximum(x, y)[live]
        np.minimum.at(at, b, a)
        while ((up := at[at]) != at).any():
            at = up


def _by_parts(edges: DataFrame, thin: Callable, schema: str) -> DataFrame | None:
    """What thin leaves of the edges in each partition, and again in fewer ones, until one partition holds all; None if
    more than ONE are left. thin: from columns to columns of numpy, as often as wanted."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        held, n, most, names = [], 0, ONE, None
        for batch in batches:
            if len(batch):
                names = list(batch.columns)
                held.append([batch[c].to_numpy() for c in names])
                n += len(batch)
            if n > most:
                held = [thin(*(np.concatenate(c) for c in zip(*held)))]
                n = len(held[0][0])
                most = max(ONE, 2 * n)
        if names:
            yield pd.DataFrame(dict(zip(names, thin(*(np.concatenate(c) for c in zip(*held))))))

    at, before = cut(edges.mapInPandas(run, schema)), None
    while True:
        parts = at.count() // ONE + 1
        if parts == 1:
            return at.coalesce(1)
        if before and parts > before // 2:
            discard(at)
            return None
        less = cut(at.repartition(parts).mapInPandas(run, schema))
        discard(at)
        at, before = less, parts


def _stars(u, v):
    """Stars around the smallest vertex of each component that the edges make."""
    import numpy as np

    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    return ids[_least(at[: len(u)], at[len(u) :], len(ids))], ids


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component): smallest id of each connected component, for every end of an edge. Partitions are thinned to
    stars until one task holds them; if that is too much, labels hop to their label's label, in rounds."""
    edges = edges.select("u", "v").where("u IS NOT NULL AND v IS NOT NULL")
    if {t for _, t in edges.dtypes} <= {"bigint", "int"}:
        kind = edges.schema["u"].dataType
        edges = cut(edges.select(F.col("u").cast("bigint"), F.col("v").cast("bigint")))
        stars = _by_parts(edges, _stars, "u bigint, v bigint")
        if stars is not None:

            def run(batches: Iterator) -> Iterator:
                import pandas as pd

                d = pd.concat([pd.DataFrame({"u": [], "v": []}, dtype="int64"), *batches])
                label, ids = _stars(d["u"].to_numpy(), d["v"].to_numpy())
                yield pd.DataFrame({"id": ids, "component": label})

            out = cut(stars.mapInPandas(run, "id bigint, component bigint"))
            discard(edges, stars)
            return out.select(F.col("id").cast(kind), F.col("component").cast(kind))
    return _hops(edges, max_rounds)


def _hops(edges: DataFrame, max_rounds: int) -> DataFrame:
    sym = cut(both_ways(edges).distinct())
    at = cut(sym.groupBy(F.col("u").alias("id")).agg(F.least(F.min("v"), F.first("u")).alias("component")))
    for _ in range(max_rounds):
        near = sym.join(at.select(F.col("id").alias("v"), "component"), "v").groupBy(F.col("u").alias("id")).agg(F.min("component").alias("near"))
        step = at.join(near, "id").select("id", F.least("component", "near").alias("c"), "component")
        new = cut(step.join(at.select(F.col("id").alias("c"), F.col("component").alias("hop")), "c", "left").select("id", F.least("c", F.coalesce("hop", "c")).alias("new"), "component"))
        at = new.select("id", F.col("new").alias("component"))
        if new.where("new <> component").isEmpty():
            return at
    raise RuntimeError("components did not settle; raise max_rounds")


def largest_component(labels: DataFrame) -> DataFrame:
    """(id) of the largest component; of equals, the one of the smallest label."""
    top = labels.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1)
    return labels.join(F.broadcast(top.select("component")), "component", "left_semi").select("id")


def degrees(edges: DataFrame) -> DataFrame:
    d = both_ways(edges)
    w = F.sum("weight") if "weight" in edges.columns else F.count("*")
    return d.groupBy(F.col("u").alias("id")).agg(F.count("*").alias("degree"), w.alias("weighted_degree"))


def clustering(edges: DataFrame) -> DataFrame:
    """(id, clustering): geometric mean of normalised weights over the triangles of a vertex."""
    top = edges.agg(F.max("weight").cast("double").alias("top"))
    e = edges.select("u", "v", F.col("weight").cast("double").alias("w"))
    tri = (
        e.select(F.col("u").alias("a"), F.col("v").alias("b"), F.col("w").alias("w1"))
        .join(e.select(F.col("u").alias("b"), F.col("v").alias("c"), F.col("w").alias("w2")), "b")
        .join(e.select(F.col("u").alias("a"), F.col("v").alias("c"), F.col("w").alias("w3")), ["a", "c"])
        .crossJoin(F.broadcast(top))  # one row
        .select(F.explode(F.array("a", "b", "c")).alias("id"), F.pow(F.col("w1") * F.col("w2") * F.col("w3") / F.pow("top", F.lit(3.0)), F.lit(1 / 3)).alias("t"))
        .groupBy("id").agg(F.sum("t").alias("t"))
    )
    d = degrees(edges)
    return d.join(tri, "id", "left").select("id", F.when(F.col("degree") < 2, 0.0).otherwise(2 * F.coalesce("t", F.lit(0.0)) / (F.col("degree") * (F.col("degree") - 1))).alias("clustering"))


def global_metrics(edges: DataFrame, vertices: DataFrame | None = None, labels: DataFrame | None = None) -> DataFrame:
    """One row: nodes, edges, density, components, lcc_size, lcc_share, mean_degree, mean_weighted_degree."""
    labels = components(edges) if labels is None else labels
    ids = labels.select("id") if vertices is None else vertices.select("id").unionAll(labels.select("id")).distinct()
    n = ids.agg(F.count("*").alias("nodes"))
    m = edges.agg(F.count("*").alias("edges"), F.coalesce(F.sum("weight"), F.lit(0)).alias("w"))
    c = labels.groupBy("component").agg(F.count("*").alias("k")).agg(F.count("*").alias("c"), F.coalesce(F.max("k"), F.lit(1)).alias("lcc"), F.coalesce(F.sum("k"), F.lit(0)).alias("linked"))
    r = n.crossJoin(m).crossJoin(c)  # one row each
    return r.select("nodes", "edges", (2.0 * F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1))).alias("density"), (F.col("c") + F.col("nodes") - F.col("linked")).alias("components"),
                    F.col("lcc").alias("lcc_size"), (100.0 * F.col("lcc") / F.col("nodes")).alias("lcc_share"), (2.0 * F.col("edges") / F.col("nodes")).alias("mean_degree"), (2.0 * F.col("w") / F.col("nodes")).alias("mean_weighted_degree"))


def path_centralities(edges: DataFrame, weighted: bool = False, limit: int = 2_000_000) -> DataFrame:
    """(id, betweenness, closeness, harmonic, eccentricity), exact, one search from each vertex.

    Every task needs the whole graph, so it is sent to the executors, and only below `limit` edges (about 16
    MB); above, exact path centralities are out of reach anyway, and it raises. weighted takes the weight as
    a length, as a snapshot does; closeness, harmonic and eccentricity count steps."""
    spark = edges.sparkSession
    m = edges.count()
    if m > limit:
        raise ValueError(f"{m} edges: exact path centralities are limited to {limit}")
    import numpy as np

    cols = ["u", "v", *(["weight"] if weighted else [])]
    e = edges.select(*cols).toPandas()
    sent = spark.sparkContext.broadcast((e["u"].to_numpy(np.int64), e["v"].to_numpy(np.int64), e["weight"].to_numpy(float) if weighted else None))
    sources = edges.select("u").union(edges.select("v")).distinct()

    def run(batches: Iterator) -> Iterator:
        import heapq
        from collections import deque

        import pandas as pd

        us, vs, ws = sent.value
        near: dict[int, list] = {}
        for i, (a, b) in enumerate(zip(us.tolist(), vs.tolist())):
            w = ws[i] if ws is not None else 1.0
            near.setdefault(a, []).append((b, w))
            near.setdefault(b, []).append((a, w))
        n = len(near)
        total: dict[int, float] = {}
        rows = []
        for batch in batches:
            for s in batch["u"].tolist():
                steps, queue = {s: 0}, deque([s])
                while queue:
                    x = queue.popleft()
                    for y, _ in near[x]:
                        if y not in steps:
                            steps[y] = steps[x] + 1
                            queue.append(y)
                far, reach = sum(steps.values()), len(steps) - 1
                rows.append((s, (reach / far) * (reach / (n - 1)) if far else 0.0, sum(1 / d for d in steps.values() if d), max(steps.values())))
                order, before, paths = [], {s: []}, {s: 1.0}
                if ws is None:
                    dist, q = {s: 0}, deque([s])
                    while q:
                        x = q.popleft()
                        order.append(x)
                        for y, _ in near[x]:
                            if y not in dist:
                                dist[y], paths[y], before[y] = dist[x] + 1, 0.0, []
                                q.append(y)
                            if dist[y] == dist[x] + 1:
                                paths[y] += paths[x]
                                before[y].append(x)
                else:
                    done, seen, heap = {}, {s: 0.0}, [(0.0, s)]
                    while heap:
                        d, x = heapq.heappop(heap)
                        if x in done:
                            continue
                        done[x] = d
                        order.append(x)
                        for y, w in near[x]:
                            e_ = d + w
                            if y in done:
                                continue
                            if y not in seen or e_ < seen[y] - 1e-12:
                                seen[y], paths[y], before[y] = e_, paths[x], [x]
                                heapq.heappush(heap, (e_, y))
                            elif abs(e_ - seen[y]) <= 1e-12:
                                paths[y] += paths[x]
                                before[y].append(x)
                share = dict.fromkeys(order, 0.0)
                for y in reversed(order):
                    for x in before[y]:
                        share[x] += paths[x] / paths[y] * (1 + share[y])
                    if y != s:
                        total[y] = total.get(y, 0.0) + share[y]
        yield pd.DataFrame([(i, "own", c, h, float(x)) for i, c, h, x in rows] + [(i, "part", b / ((n - 1) * (n - 2)) if n > 2 else 0.0, 0.0, 0.0) for i, b in total.items()], columns=["id", "kind", "a", "b", "c"])

    cores = spark.sparkContext.defaultParallelism
    parts = sources.repartition(4 * cores, "u").mapInPandas(run, "id bigint, kind string, a double, b double, c double")
    own = F.col("kind") == "own"
    return parts.groupBy("id").agg(F.sum(F.when(~own, F.col("a")).otherwise(0.0)).alias("betweenness"), F.max(F.when(own, F.col("a"))).alias("closeness"), F.max(F.when(own, F.col("b"))).alias("harmonic"), F.max(F.when(own, F.col("c"))).cast("int").alias("eccentricity"))


def diameter(edges: DataFrame, limit: int = 2 * ONE) -> DataFrame:
    """One row: (members, diameter) of the largest component, of equals the one of the smallest id; exact. Searches from
    few vertices bound the eccentricity of all; the next is one whose bounds leave the most open. One task needs the
    whole graph; above `limit` edges it raises."""
    edges = cut(edges.select(F.col("u").cast("bigint"), F.col("v").cast("bigint")))
    m = edges.count()
    if m > limit:
        raise ValueError(f"{m} edges: the exact diameter is limited to {limit}")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        ids, a, b = _held(batches)
        n = len(ids)
        if not n:
            return
        label = _least(a, b, n)
        own = label == np.bincount(label).argmax()
        first = np.searchsorted(a, np.arange(n + 1))
        degree = np.diff(first)

        def steps(s: int):
            far, at, d = np.full(n, -1), np.array([s]), 0
            while len(at):
                far[at] = d
                d, k = d + 1, degree[at]
                near = b[np.repeat(first[at] - np.cumsum(k) + k, k) + np.arange(k.sum())]
                at = np.unique(near[far[near] < 0])
            return far

        low, high, most = np.zeros(n, np.int64), np.full(n, n), 0
        open_, turn = np.flatnonzero(own), 0
        while len(open_):
            bound, turn = (-low if turn else high)[open_], 1 - turn  # the most by what may be, then the least by what must be
            best = open_[bound == bound.max()]
            far = steps(best[degree[best].argmax()])
            e = far.max()
            most = max(most, e)
            low, high = np.maximum(low, np.maximum(far, e - far)), np.minimum(high, e + far)
            high[far == 0] = low[far == 0] = e
            open_ = open_[(high[open_] > most) & (low[open_] < high[open_])]
            most = max(most, low[own].max())
            open_ = open_[high[open_] > most]
        yield pd.DataFrame({"members": [own.sum()], "diameter": [most]})

    found = edges.coalesce(1).mapInPandas(run, "members bigint, diameter int")
    return found.agg(F.coalesce(F.max("members"), F.lit(0)).alias("members"), F.max("diameter").alias("diameter"))


def _power(edges: DataFrame, factor: float, own: float, plus: float, start: float, unit: bool, rounds: int, enough) -> Iterator[DataFrame]:
    """(id, x, old) after every tenth round of x = factor * A x + own * x + plus, of length one if unit; old is
    x of the round before. Rounds between two checkpoints are one plan; a vertex is its own neighbour with
    weight own, which brings its old value along. Ends after a frame that is enough, or after all rounds."""
    sym = both_ways(edges.select("u", "v", (factor * F.col("weight")).cast("double").alias("w")))
    ids = sym.select("u").distinct()
    sym = cut(sym.unionAll(ids.select("u", F.col("u").alias("v"), F.lit(float(own)).alias("w"))))
    at = cut(ids.select(F.col("u").alias("id"), F.lit(float(start)).alias("x")))
    length = lambda c: F.sqrt(F.sum(F.col(c) * F.col(c))).alias(c)
    for done in range(0, rounds, 10):
        for _ in range(min(10, rounds - done)):
            d = sym.join(at.select(F.col("id").alias("v"), "x"), "v").groupBy(F.col("u").alias("id"))
            at = d.agg((F.sum(F.col("w") * F.col("x")) + plus).alias("x"), F.sum(F.when(F.col("u") == F.col("v"), F.col("x"))).alias("old"))
        at = cut(at)
        if unit:
            by = at.agg(length("x"), length("old")).first()
            at = at.select("id", (F.col("x") / F.lit(by.x)).alias("x"), (F.col("old") / F.lit(by.old)).alias("old"))
        yield at
        if enough(at):
            return


class _Settled:
    """Whether the last change of a vector is small: below tolerance in its length, and below the number of
    vertices * 1e-6 in sum, which is the reference's test and alone grows lax with the number of vertices."""

    def __init__(self, tolerance: float):
        self.tolerance, self.lax = tolerance, True

    def __call__(self, at: DataFrame) -> bool:
        c = F.col("x") - F.col("old")
        r = at.agg(F.count("*").alias("n"), F.sum(F.abs(c)).alias("sum"), F.sqrt(F.sum(c * c)).alias("change"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("length")).first()
        self.lax = not r.n or r.sum < r.n * 1e-6
        return not r.n or self.lax and r.change <= self.tolerance * r.length


def _last(frames: Iterator[DataFrame]) -> DataFrame:
    for at in frames:
        pass
    return at.select("id", "x")


def pagerank(edges: DataFrame, damping: float = 0.85, rounds: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """(id, pagerank), weighted, of the vertices with an edge."""
    strength = degrees(edges).select("id", F.col("weighted_degree").cast("double").alias("k"))
    d = both_ways(edges).join(strength.select(F.col("id").alias("v"), "k"), "v").select("u", "v", (F.col("weight") / F.col("k")).alias("weight"))
    sym = cut(d)
    at = cut(strength.select("id"))
    n = at.count()
    if not n:
        return at.withColumn("pagerank", F.lit(0.0))
    at = at.withColumn("x", F.lit(1.0 / n))
    for _ in range(rounds):
        s = sym.join(at.select(F.col("id").alias("v"), "x"), "v").groupBy(F.col("u").alias("id")).agg(F.sum(F.col("weight") * F.col("x")).alias("s"))
        new = cut(at.withColumnRenamed("x", "old").join(s, "id").select("id", "old", ((1 - damping) / n + damping * F.col("s")).alias("x")))
        at = new.select("id", "x")
        if new.agg(F.sum(F.abs(F.col("x") - F.col("old")))).first()[0] < n * tolerance:
            break
    return at.select("id", F.col("x").alias("pagerank"))


def eigenvector(edges: DataFrame, rounds: int = 1000, tolerance: float = 1e-8) -> DataFrame:
    """(id, eigenvector), weighted, of length one. Iterates A + I, which has the same leading vector. 0 for all
    when even the reference's test isn't met after all rounds, as in the reference."""
    settled = _Settled(tolerance)
    at = _last(_power(edges, 1.0, 1.0, 0.0, 1.0, True, rounds, settled))
    return at.select("id", (F.col("x") if settled.lax else F.lit(0.0)).alias("eigenvector"))


def leading_eigenvalue(edges: DataFrame, rounds: int = 10_000, tolerance: float = 1e-8) -> float:
    """Largest eigenvalue of the unweighted adjacency matrix. Rayleigh quotients grow towards it; ends when ten
    rounds change them by less than tolerance, relatively."""
    e = edges.select("u", "v").withColumn("weight", F.lit(1.0))
    tops = [0.0]

    def enough(at: DataFrame) -> bool:
        s = both_ways(e).join(at.select(F.col("id").alias("v"), "x"), "v").groupBy(F.col("u").alias("id")).agg(F.sum("x").alias("s"))
        tops.append(at.join(s, "id").agg(F.sum(F.col("s") * F.col("x")) / F.sum(F.col("x") * F.col("x"))).first()[0] or 0.0)
        return tops[-1] - tops[-2] <= tolerance * tops[-1]

    _last(_power(e, 1.0, 1.0, 0.0, 1.0, True, rounds, enough))
    if len(tops) > 2 and tops[-1] - tops[-2] > tolerance * tops[-1]:
        raise RuntimeError("the leading eigenvalue did not settle; raise rounds")
    return tops[-1]


def _held(batches: Iterator):
    """The ids of a graph, and as places among them the two ends of every edge, both ways, in the order of the first."""
    import numpy as np
    import pandas as pd

    d = pd.concat([pd.DataFrame({"u": [], "v": []}, dtype="int64"), *batches])
    ids, at = np.unique(np.concatenate([d["u"].to_numpy(), d["v"].to_numpy()]), return_inverse=True)
    a, b = np.concatenate([at[: len(d)], at[len(d) :]]).astype(np.int32), np.concatenate([at[len(d) :], at[: len(d)]]).astype(np.int32)
    order = np.argsort(a, kind="stable")
    return ids, a[order], b[order]


def katz(edges: DataFrame, part: float = 0.85, rounds: int = 2000, tolerance: float = 1e-8) -> DataFrame:
    """(id, katz), unweighted, alpha = part / leading eigenvalue, of length one. 0 for all when it doesn't
    settle, as in the reference. The rounds are those of one task up to ONE edges, else of the session."""
    edges = cut(edges.select("u", "v").withColumn("weight", F.lit(1.0)))
    if edges.count() > ONE:
        return _katz_by_rounds(edges, part, rounds, tolerance)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        ids, a, b = _held(batches)
        n = len(ids)
        if not n:
            return
        around = lambda x: np.bincount(a, x[b], n)
        x, before = np.ones(n), 0.0
        for _ in range(1000):  # as leading_eigenvalue
            for _ in range(10):
                x = x + around(x)
            x /= np.linalg.norm(x)
            top = around(x) @ x / (x @ x)
            if top - before <= tolerance * top:
                break
            before = top
        else:
            raise RuntimeError("the leading eigenvalue did not settle; raise rounds")
        x, lax = np.zeros(n), True
        for done in range(0, rounds, 10):  # as _power and _Settled
            for _ in range(min(10, rounds - done)):
                x, old = part / top * around(x) + 1.0, x
            c = np.abs(x - old)
            lax = c.sum() < n * 1e-6
            if lax and np.linalg.norm(c) <= tolerance * np.linalg.norm(x):
                break
        yield pd.DataFrame({"id": ids, "katz": x / np.linalg.norm(x) if lax else 0.0})

    return edges.select(F.col("u").cast("bigint"), F.col("v").cast("bigint")).coalesce(1).mapInPandas(run, "id bigint, katz double")


def _katz_by_rounds(edges: DataFrame, part: float, rounds: int, tolerance: float) -> DataFrame:
    top = leading_eigenvalue(edges)
    settled = _Settled(tolerance)
    at = _last(_power(edges, part / top if top else 0.0, 0.0, 1.0, 0.0, False, rounds, settled))
    norm = F.broadcast(at.agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm")))  # one row
    return at.crossJoin(norm).select("id", (F.col("x") / F.col("norm") if settled.lax else F.lit(0.0)).alias("katz"))


def cumulative(pairs: DataFrame, period: str, periods: DataFrame) -> DataFrame:
    """(period, nodes, edges, weight, mean_degree) of the graph of all pairs up to each period. pairs: u, v,
    period, weight. Each pair and vertex counts from the period it first appears in."""
    first = pairs.groupBy("u", "v").agg(F.min(period).alias(period)).groupBy(period).agg(F.count("*").alias("new_edges"))
    weight = pairs.groupBy(period).agg(F.sum("weight").alias("new_weight"))
    nodes = both_ways(pairs.select("u", "v", period)).groupBy("u").agg(F.min(period).alias(period)).groupBy(period).agg(F.count("*").alias("new_nodes"))
    w = Window.orderBy(period).rowsBetween(Window.unboundedPreceding, 0)  # one row for each period
    d = periods.join(first, period, "left").join(weight, period, "left").join(nodes, period, "left").na.fill(0)
    d = d.select(period, F.sum("new_nodes").over(w).alias("nodes"), F.sum("new_edges").over(w).alias("edges"), F.sum("new_weight").over(w).alias("weight"))
    return d.withColumn("mean_degree", F.when(F.col("nodes") > 0, 2.0 * F.col("edges") / F.col("nodes")))


def entry_periods(pairs: DataFrame, period: str, values: list, start, least: int) -> DataFrame:
    """(id, period): when a vertex first is in the largest component, from the first period on in which that
    component has `least` vertices and which isn't before `start`. Partitions are thinned to the pairs that first join
    two components, which connect the same in every period; one task goes through the periods of what is left. If that
    is too much, labels are carried from period to period, so that only new edges and the old labels are looked at."""
    values = sorted(values)
    if not values:
        return pairs.select(F.col("u").alias("id"), period).limit(0)
    known = F.array(*map(F.lit, values)).cast(f"array<{dict(pairs.dtypes)[period]}>")
    ranked = pairs.select(F.col("u").cast("bigint"), F.col("v").cast("bigint"), (F.array_position(known, F.col(period)) - 1).cast("bigint").alias("t")).where("t >= 0")

    def thin(u, v, t):
        import numpy as np

        ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        a, b, label, out = at[: len(u)], at[len(u) :], np.arange(len(ids)), []
        order = np.argsort(t, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(t[order])) + 1):
            new = _least(label[a[own]], label[b[own]], len(ids))
            gone = np.flatnonzero(new != np.arange(len(ids)))  # labels that take a smaller one
            out.append((ids[new[gone]], ids[gone], np.full(len(gone), t[own[0]])))
            label = new[label]
        return tuple(np.concatenate(c) for c in zip(*out))

    joins = _by_parts(ranked, thin, "u bigint, v bigint, t bigint")
    if joins is None:
        return _entries_by_rounds(pairs, period, values, start, least)
    from_ = next((i for i, x in enumerate(values) if x >= start), len(values))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        d = pd.concat([pd.DataFrame({"u": [], "v": [], "t": []}, dtype="int64"), *batches])
        if not len(d):
            return
        t, m = d["t"].to_numpy(), len(d)
        ids, at = np.unique(np.concatenate([d["u"].to_numpy(), d["v"].to_numpy()]), return_inverse=True)
        label, entry = np.arange(len(ids)), np.full(len(ids), -1)
        for i in range(len(values)):
            own = np.flatnonzero(t == i)
            label = _least(label[at[:m][own]], label[at[m:][own]], len(ids))[label]
            sizes = np.bincount(label)
            if i >= from_ and sizes.max() >= max(least, 2):
                entry[(label == sizes.argmax()) & (entry < 0)] = i  # of equals, the one of the smallest label
        came = entry >= 0
        yield pd.DataFrame({"id": ids[came], "t": entry[came]})

    return cut(joins.mapInPandas(run, "id bigint, t bigint")).select("id", F.element_at(known, (F.col("t") + 1).cast("int")).alias(period))


def _entries_by_rounds(pairs: DataFrame, period: str, values: list, start, least: int) -> DataFrame:
    labels, out = None, None
    for t in values:
        new = pairs.where(F.col(period) == F.lit(t)).select("u", "v")
        e = new if labels is None else new.unionAll(labels.where("id <> component").select(F.col("component").alias("u"), F.col("id").alias("v")))
        labels = cut(components(e))
        if t >= start:
            lcc = largest_component(labels)
            size = F.broadcast(lcc.agg(F.count("*").alias("_n")))  # one row
            come = cut(lcc.crossJoin(size).where(F.col("_n") >= least).select("id", F.lit(t).alias(period)))
            out = come if out is None else out.unionAll(come)
    if out is None:
        return pairs.select(F.col("u").alias("id"), period).limit(0)
    return out.groupBy("id").agg(F.min(period).alias(period))


def partners(links: DataFrame, unit: str, over: str) -> DataFrame:
    """(id, partners): distinct others a unit shares something with, one at least."""
    p = both_ways(project(links, unit, over).select("u", "v")).groupBy(F.col("u").alias("id")).agg(F.count("*").alias("partners"))
    return links.select(F.col(unit).alias("id")).where("id IS NOT NULL").distinct().join(p, "id", "left").select("id", F.coalesce("partners", F.lit(1)).alias("partners"))
