"""Filling containers of fixed capacity with texts (problem 9).

Sizes are whole numbers up to the capacity, so the instance is its histogram: at most `capacity` rows,
whatever the number of texts. ``plan`` works on the histogram: the reduction procedure of Martello and
Toth fixes containers that provably dominate every other container of their largest item (a perfect
partner; the only partner that fits; the best of one or two further items), then the remainder is packed
best-fit by falling size. It gives kinds of container with multiplicities. ``pack`` numbers the texts of
each size - in salted blocks, so that a hot size isn't one task - and looks every number up in the plan.

The plan is bounded: a size adds at most two kinds of container, and a container of capacity c holds at
most sqrt(2c) different sizes. So it may be collected and sent to the executors.

Defined results: a text longer than the capacity is divided into full pieces and a rest; no other text is
divided. Null, empty and zero-token texts take no room and stand at the start of container 1. Kinds with
a null or non-positive capacity or an unknown tokenizer give no rows. Repeated doc_ids are packed as often
as they occur; ties between texts of one size are broken by a hash of the id, then the id.
"""

from __future__ import annotations

import base64
from bisect import bisect_right, insort
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, partitions, spread
from . import bpe

Kind = tuple[int, list[tuple[int, int]]]  # how many containers, and (size, items) in each


def reduce_dominated(hist: dict[int, int], capacity: int) -> tuple[list[Kind], dict[int, int]]:
    """Containers that may be fixed without loss, and what is left of the histogram."""
    left = {s: n for s, n in hist.items() if n}
    there = sorted(left)
    fixed: list[Kind] = []

    def take(k: int, *sizes: int) -> None:
        items: dict[int, int] = {}
        for s in sizes:
            items[s] = items.get(s, 0) + 1
        k = min([k, *(left[s] // c for s, c in items.items())])
        fixed.append((k, sorted(items.items(), reverse=True)))
        for s, c in items.items():
            left[s] -= k * c
            if not left[s]:
                del left[s]
                there.pop(bisect_right(there, s) - 1)

    def largest(room: int, *used: int) -> int:
        """The largest size up to room of which an item besides the used ones is left; 0 if none."""
        for i in range(bisect_right(there, room) - 1, -1, -1):
            if left[there[i]] > used.count(there[i]):
                return there[i]
        return 0

    for w in sorted(left, reverse=True):
        while left.get(w):
            room = capacity - w
            x = largest(room, w)
            if not x:
                take(left[w], w)
                continue
            few = [s for s in there[:4] for _ in range(min(3, left[s] - (s == w)))][:3]
            if x == room or len(few) < 2 or few[0] + few[1] > room:
                take(left[w], w, x)
                continue
            if len(few) > 2 and sum(few) <= room:
                break  # three or more further items fit: dominance is not proven here
            best = low = 0
            for a in there[: bisect_right(there, x)]:
                if left[a] > (a == w) and (b := largest(room - a, w, a)):
                    best, low = max(best, a + b), max(low, min(a, b))
            y = largest(room - x, w, x)
            if x >= best:
                take(left[w], w, x)
            elif y and y >= low:
                take(left[w], w, x, y)
            else:
                break
    return fixed, left


def best_fit(hist: dict[int, int], capacity: int) -> list[Kind]:
    """Best-fit by falling size, all items of a size and all like containers at once."""
    rooms: dict[int, list[Kind]] = {}
    order: list[int] = []
    done: list[Kind] = []

    def put(room: int, kind: Kind) -> None:
        if not room:
            done.append(kind)
        elif room in rooms:
            rooms[room].append(kind)
        else:
            rooms[room] = [kind]
            insort(order, room)

    for s in sorted(hist, reverse=True):
        n = hist[s]
        while n:
            i = bisect_right(order, s - 1)
            if i == len(order):
                each = capacity // s
                if n // each:
                    put(capacity - each * s, (n // each, [(s, each)]))
                if n % each:
                    put(capacity - n % each * s, (1, [(s, n % each)]))
                break
            room = order[i]
            k, items = rooms[room].pop()
            if not rooms[room]:
                del rooms[room]
                order.pop(i)
            each = room // s
            full = min(k, n // each)
            n -= full * each
            if full:
                put(room - each * s, (full, [*items, (s, each)]))
            if k > full and n:  # fewer items than one container takes
                put(room - n * s, (1, [*items, (s, n)]))
                full, n = full + 1, 0
            if k > full:
                put(room, (k - full, items))
    return done + [kind for kinds in rooms.values() for kind in kinds]


def plan(hist: dict[int, int], capacity: int) -> list[Kind]:
    fixed, left = reduce_dominated(hist, capacity)
    return fixed + best_fit(left, capacity)


def _counters(names: list[str], files: dict[str, bytes]) -> list:
    """For each tokenizer a function that counts the tokens of a list of texts."""
    def counter(name: str):
        raw = files[name]
        if name.startswith("byte_"):
            try:  # only numbers of tokens are needed; the public library's are those of our encoder
                import tiktoken
            except ImportError:
                b = bpe.ready(raw)
                return lambda texts: [len(b.encode(t)) for t in texts]
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in raw.splitlines() if x)}
            e = tiktoken.Encoding(name, pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
            return lambda texts: [len(x) for x in e.encode_ordinary_batch(texts, num_threads=1)]
        if name.startswith("piece_"):
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_proto=raw)
            return lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_str(raw.decode())
        t.encode_special_tokens = True
        return lambda texts: [len(e.ids) for e in t.encode_batch_fast(texts, add_special_tokens=False)]

    return [counter(n) for n in names]


_COUNTERS: dict[tuple, list] = {}


def token_counts(docs: DataFrame, tokenizers: list[str], folder: str | None = None) -> DataFrame:
    """(doc_id, counts: array<int>, one for each tokenizer) of every row; null texts count 0."""
    ends = {"byte_": ".tiktoken", "piece": ".model", "word_": ".json"}
    files = docs.sparkSession.sparkContext.broadcast({n: Path(f"{folder or bpe.TOKENIZERS}/{n}{ends[n[:5]]}").read_bytes() for n in tokenizers})

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        key = tuple(tokenizers)
        if key not in _COUNTERS:
            _COUNTERS[key] = _counters(tokenizers, files.value)
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                texts = [t or "" for t in part.column(1).to_pylist()]
                counts = list(zip(*[count(texts) for count in _COUNTERS[key]]))
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(counts, pa.list_(pa.int32()))], ["doc_id", "counts"])

    return spread(docs.select("doc_id", "text")).mapInArrow(run, "doc_id bigint, counts array<int>")


KNOWN = ("byte_bpe_50k", "byte_bpe_multi_50k", "piece_bpe_32k", "word_bpe_49k")


def pack(docs: DataFrame, kinds: DataFrame, folder: str | None = None, salts: int | None = None) -> DataFrame:
    """(conteneur_id, doc_id, piece, container, position, start, end): piece `piece` of a text, its tokens
    start to end (excluded), stands at `position` of container number `container`. kinds is a small
    table of settings. salts: blocks of one size, else as many as the documents' bytes ask for."""
    spark = docs.sparkSession
    salts = salts or max(64, 4 * partitions(docs.select("doc_id", "text")))
    rows = [r for r in kinds.select("conteneur_id", "tokenizer", "capacite").distinct().collect() if r.capacite and r.capacite > 0 and r.tokenizer in KNOWN]
    if not rows:
        return spark.createDataFrame([], "conteneur_id int, doc_id bigint, piece int, container bigint, position int, start int, end int")
    names = sorted({r.tokenizer for r in rows})
    each = F.array(*[F.struct(F.lit(r.conteneur_id).cast("int").alias("conteneur_id"), F.lit(r.capacite).alias("capacity"), F.col("counts")[names.index(r.tokenizer)].alias("tokens")) for r in rows])
    sized = cut(token_counts(docs, names, folder)).select("doc_id", F.explode(each).alias("k")).select("k.conteneur_id", "k.capacity", "k.tokens", "doc_id")
    pieces = sized.withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("tokens") / F.col("capacity")).cast("int") - 1)))).select(
        "conteneur_id", "doc_id", "piece", (F.col("piece") * F.col("capacity")).alias("start"), F.least("tokens", (F.col("piece") + 1) * F.col("capacity")).alias("end")
    ).withColumn("size", F.col("end") - F.col("start")).withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))

    blocks = cut(pieces.where("size > 0").groupBy("conteneur_id", "size", "salt").agg(F.count("*").alias("n")))  # at most capacity x salts rows
    hist: dict[int, dict[int, int]] = {}
    for r in blocks.groupBy("conteneur_id", "size").agg(F.sum("n").alias("n")).collect():  # at most `capacity` rows a kind
        hist.setdefault(r.conteneur_id, {})[r["size"]] = r.n
    slots: dict[tuple[int, int], list[tuple]] = {}
    for r in rows:
        used: dict[int, int] = {}
        base = 1
        for k, items in plan(hist.get(r.conteneur_id, {}), r.capacite):
            at = 0
            for s, c in items:
                slots.setdefault((r.conteneur_id, s), []).append((used.get(s, 0), c, base, at))
                used[s] = used.get(s, 0) + k * c
                at += s * c
            base += k
    sent = spark.sparkContext.broadcast(slots)

    before = Window.partitionBy("conteneur_id", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    own = Window.partitionBy("conteneur_id", "size", "salt").orderBy("doc_id", "piece")
    ranked = pieces.where("size > 0").withColumn("rank", F.row_number().over(own) - 1).join(offsets, ["conteneur_id", "size", "salt"]).select(
        "conteneur_id", "doc_id", "piece", "start", "end", "size", (F.col("rank") + F.col("before")).alias("rank")
    )

    def place(batches: Iterator) -> Iterator:
        import numpy as np

        ready: dict = {}
        for b in batches:
            container, position = np.zeros(len(b), np.int64), np.zeros(len(b), np.int32)
            for key, at in b.groupby(["conteneur_id", "size"]).indices.items():
                if key not in ready:
                    ready[key] = np.array(sent.value[key], np.int64).T
                first, count, base, off = ready[key]
                rank = b["rank"].to_numpy()[at]
                i = np.searchsorted(first, rank, side="right") - 1
                container[at] = base[i] + (rank - first[i]) // count[i]
                position[at] = off[i] + (rank - first[i]) % count[i] * key[1]
            yield b[["conteneur_id", "doc_id", "piece"]].assign(container=container, position=position, start=b["start"], end=b["end"])

    schema = "conteneur_id int, doc_id bigint, piece int, container bigint, position int, start int, end int"
    nothing = pieces.where("size = 0").select("conteneur_id", "doc_id", "piece", F.lit(1).cast("bigint").alias("container"), F.lit(0).alias("position"), "start", "end")
    return ranked.mapInPandas(place, schema).unionByName(nothing)
