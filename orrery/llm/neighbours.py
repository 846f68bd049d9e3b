"""Approximate nearest neighbours by stable projections and kd-trees.

Unit vectors are projected to ``DIMS`` dimensions by a Gaussian matrix. Gaussians are 2-stable: the squared distance of two
projections is that of the vectors times a chi-square value with ``DIMS`` degrees of freedom. So once the nearest
projections are verified as far out as r, a vector nearer than the k-th found, at distance d, has still been missed with a
probability of at most 1 - chi2(r^2 / d^2); the search of a query stops where that value reaches ``SURE``.

The kd-tree has two layers. The upper one splits the projected space into cells, by medians of a sample of at most ``SAMPLE`` vectors;
every vector goes to its cell, and a cell is dealt in blocks of at most ``BLOCK`` vectors or so. The lower one is built by each task over
its block. A query is first searched in its own cell. What it finds there bounds how far out the test can ask for
projections, and the query then visits each other cell that lies within that reach. In a block, leaves are taken nearest first, in
groups of doubling size, and the test is held after each group.

Equal vectors are one class, searched once, of which each answer needs only the ``K`` + 1 smallest ids; so many copies of a vector cost
no more than one. Blocks, and the queries that meet in them, are dealt by hash, so a crowded cell has many tasks.

Defined cases: vectors that are null, empty or zero, hold null or non-finite components, or whose length isn't the table's
commonest (ties: the longest) take no part; so do rows without an id; rows that share an id count as one vector, the one that sorts
first; a query with fewer candidates than k gets them all; further columns don't matter; an empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from orrery.llm.embeddings import _groups, _matrix, usable
from orrery.llm.shared import saved

K, DIMS, SURE, SEED = 5, 8, 0.98, 13
#: Vectors that choose the upper splits, vectors and queries of a block, vectors of a leaf, and cells at most (their splits and boxes are broadcast, 17 MB at most).
SAMPLE, BLOCK, QUERIES, LEAF, CELLS = 65_536, 2048, 512, 32, 65_536


def chi_square(x: float) -> float:
    """The share of chi-square values with DIMS (an even number of) degrees of freedom below x."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** j / math.factorial(j) for j in range(DIMS // 2))


def reach(sure: float = SURE) -> float:
    """The x with chi_square(x) = sure: the test asks for projections within sqrt(x) times the distance of the k-th vector found."""
    low, high = 0.0, 1000.0
    for _ in range(80):
        low, high = ((low + high) / 2, high) if chi_square((low + high) / 2) < sure else (low, (low + high) / 2)
    return high


def _projection(width: int):
    import numpy as np

    return np.random.default_rng(SEED).standard_normal((width, DIMS))


class Splits:
    """The upper layer: a complete kd-tree; node j has children 2j + 1 and 2j + 2, and each leaf is a cell with its box."""

    def __init__(self, sample, depth: int):
        import numpy as np

        self.depth = depth
        self.axis, self.at = np.zeros(2**depth - 1, np.int64), np.zeros(2**depth - 1)
        self.low = np.full((2 ** (depth + 1) - 1, DIMS), -np.inf)
        self.high = -self.low
        held = {0: sample}
        for j in range(2**depth - 1):
            p = held.pop(j)
            self.axis[j] = a = int(np.argmax(np.ptp(p, axis=0))) if len(p) else 0
            self.at[j] = np.median(p[:, a]) if len(p) else 0.0
            left = p[:, a] < self.at[j]
            held[2 * j + 1], held[2 * j + 2] = p[left], p[~left]
            for child in (2 * j + 1, 2 * j + 2):
                self.low[child], self.high[child] = self.low[j], self.high[j]
            self.high[2 * j + 1, a] = self.low[2 * j + 2, a] = self.at[j]
        self.low, self.high = self.low[2**depth - 1 :], self.high[2**depth - 1 :]

    def cells(self, p):
        """The cell of each projection."""
        import numpy as np

        j, rows = np.zeros(len(p), np.int64), np.arange(len(p))
        for _ in range(self.depth):
            j = 2 * j + 1 + (p[rows, self.axis[j]] >= self.at[j])
        return j - (2**self.depth - 1)


def _gaps(low, high, q):
    """The squared distance from one projection to each box."""
    import numpy as np

    gap = np.maximum(np.maximum(low - q, q - high), 0)
    return np.einsum("ij,ij->i", gap, gap)


class Block:
    """The lower layer: a kd-tree over the projections of a block, cut into leaves that lie one after the other."""

    def __init__(self, ids, u, projection):
        import numpy as np

        p = u @ projection
        leaves, todo = [], [np.arange(len(ids))]
        while todo:
            rows = todo.pop()
            if len(rows) <= LEAF:
                leaves.append(rows)
                continue
            a = int(np.argmax(np.ptp(p[rows], axis=0)))
            order = rows[np.argpartition(p[rows, a], len(rows) // 2)]
            todo += [order[: len(rows) // 2], order[len(rows) // 2 :]]
        order = np.concatenate(leaves)
        self.ids, self.u, self.p = ids[order], u[order], p[order]
        self.ends = np.cumsum([len(x) for x in leaves])
        self.starts = self.ends - [len(x) for x in leaves]
        self.low, self.high = (np.stack([f(p[x], axis=0) for x in leaves]) for f in (np.min, np.max))
        self.verified = 0

    def nearest(self, own: int, u, p, bound: float, k: int, x: float):
        """(ids, squared distances): the k nearest classes but ``own`` that the search finds before its test holds.

        ``bound`` is the squared distance of a k-th class known from elsewhere.
        """
        import numpy as np

        gaps = _gaps(self.low, self.high, p)
        order = np.argsort(gaps)
        ids, far, at, step = np.zeros(0, np.int64), np.zeros(0), 0, 1
        while at < len(order) and gaps[order[at]] <= x * bound:
            rows = np.concatenate([np.arange(self.starts[j], self.ends[j]) for j in order[at : at + step]])
            away = self.p[rows] - p
            rows = rows[(np.einsum("ij,ij->i", away, away) <= x * bound) & (self.ids[rows] != own)]
            self.verified += len(rows)
            ids, far = np.concatenate([ids, self.ids[rows]]), np.concatenate([far, np.maximum(0, 2 - 2 * (self.u[rows] @ u))])
            if len(far) >= k:
                bound = min(bound, float(np.partition(far, k - 1)[k - 1]) + 1e-12)
                keep = far <= bound  # equal distances stay, for their ids to decide
                ids, far = ids[keep], far[keep]
            at, step = at + step, 2 * step
        return ids, far


def _searched(nodes: DataFrame, visits: DataFrame, width: int, k: int, sure: float) -> DataFrame:
    """(query, node, far) from the visits (query, u, bound, cell): in each block of the cell, the nearest classes to the query.

    nodes has (node, u, cell). Both sides of a cell are dealt by hash: vectors to blocks, queries to groups, and each pair of these is a task's unit.
    """
    sizes = nodes.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    groups = visits.groupBy("cell").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("groups"))
    shape = saved(sizes.join(groups, "cell"), "shape")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = nodes.join(shape, "cell").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int")).withColumn("group", every("groups"))
    right = visits.join(shape, "cell").withColumn("group", F.pmod(F.xxhash64("query"), "groups").cast("int")).withColumn("block", every("blocks"))
    keys = ["cell", "block", "group"]
    rows = left.select(*keys, F.lit(0).alias("kind"), F.col("node").alias("id"), "u", F.lit(0.0).alias("bound"))
    rows = rows.unionAll(right.select(*keys, F.lit(1).alias("kind"), F.col("query").alias("id"), "u", "bound"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        projection, x = _projection(width), reach(sure)
        for g in _groups(batches, keys):
            g = g.combine_chunks()
            kind, ids, u, bound = g.column("kind").to_numpy(), g.column("id").to_numpy(), _matrix(g.column("u").combine_chunks()), g.column("bound").to_numpy()
            n = int((kind == 0).sum())
            if not n or n == len(kind):
                continue
            block, asked = Block(ids[:n], u[:n], projection), u[n:] @ projection
            out = [block.nearest(int(ids[n + j]), u[n + j], asked[j], float(bound[n + j]), k, x) for j in range(len(kind) - n)]
            queries = np.repeat(ids[n:], [len(o[0]) for o in out])
            yield pa.RecordBatch.from_arrays([pa.array(queries), pa.array(np.concatenate([o[0] for o in out])), pa.array(np.concatenate([o[1] for o in out]))], names=["query", "node", "far"])

    return rows.repartition(*keys).sortWithinPartitions(*keys, "kind").mapInArrow(run, "query long, node long, far double")


def _nearest_classes(nodes: DataFrame, queries: DataFrame, width: int, k: int, sure: float) -> DataFrame:
    """(query, node): for each query (node, u) at least the k nearest other classes found, or all there are."""
    import numpy as np

    n = nodes.count()
    depth = max(0, min(math.ceil(math.log2(max(1, n / BLOCK))), int(math.log2(CELLS))))
    hashed = nodes.select("u", F.xxhash64("node", F.lit(2)).alias("h"))
    share = (2 * SAMPLE) / max(1, n)  # those of low hashes, so that the driver gets no more than the sample
    few = hashed.where(F.col("h") <= min(2**63 - 1, int(share * 2**64) - 2**63)).orderBy("h").limit(SAMPLE if depth else 0)

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if x.num_rows:
                p = _matrix(x.column("u")) @ _projection(width)
                yield pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(p.ravel(), DIMS).cast(pa.list_(pa.float64()))], names=["p"])

    sample = [r["p"] for r in few.mapInArrow(projected, "p array<double>").collect()]
    splits = nodes.sparkSession.sparkContext.broadcast(Splits(np.array(sample, dtype=float).reshape(-1, DIMS), depth))

    def celled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if x.num_rows:
                cells = splits.value.cells(_matrix(x.column("u")) @ _projection(width))
                yield pa.RecordBatch.from_arrays([x.column("node"), x.column("u"), pa.array(cells)], names=["node", "u", "cell"])

    def beyond(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The other cells within a query's reach."""
        import numpy as np

        x = reach(sure)
        for batch in batches:
            for row in (batch.slice(j, 1) for j in range(batch.num_rows)):
                p = (_matrix(row.column("u")) @ _projection(width))[0]
                near = _gaps(splits.value.low, splits.value.high, p) <= x * row.column("bound")[0].as_py()
                near[row.column("cell")[0].as_py()] = False
                cells = np.flatnonzero(near)
                for j in range(0, len(cells), 4096):
                    part = cells[j : j + 4096]
                    yield pa.RecordBatch.from_arrays([pa.array(part), *(pa.concat_arrays([row.column(c)] * len(part)) for c in ("query", "u", "bound"))], names=["cell", "query", "u", "bound"])

    kind = "node long, u array<double>, cell long"
    nodes = saved(nodes.select("node", "u").mapInArrow(celled, kind), "cells")
    queries = saved(queries.select("node", "u").mapInArrow(celled, kind).withColumnRenamed("node", "query"), "queries")
    infinite = F.lit(math.inf)  # until k are found, all are wanted
    home = saved(_searched(nodes, queries.withColumn("bound", infinite), width, k, sure), "home")
    ranked = home.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("far", "node"))).where(F.col("rank") <= k)
    known = ranked.where(F.col("rank") == k).select("query", F.col("far").alias("bound"))
    asked = saved(queries.join(known, "query", "left").withColumn("bound", F.coalesce(F.col("bound") + 1e-12, infinite)), "bounds")
    visits = saved(asked.select("query", "u", "cell", "bound").mapInArrow(beyond, "cell long, query long, u array<double>, bound double"), "visits")
    away = _searched(nodes, visits, width, k, sure)
    both = home.unionAll(away).withColumn("rank", F.rank().over(Window.partitionBy("query").orderBy(F.round("far", 9)))).where(F.col("rank") <= k)
    return both.select("query", "node")


def unit(rows: DataFrame) -> DataFrame:
    """rows (node, v, ...) with ``w``, the vector in a scale (a power of two) that keeps squares in range, its length and the unit vector u."""
    scale = F.pow(F.lit(2.0), F.floor(F.log2(F.array_max(F.transform("v", F.abs)))))
    rows = rows.withColumn("scale", scale).withColumn("w", F.transform("v", lambda x: x / F.col("scale"))).drop("scale")
    rows = rows.withColumn("norm", F.sqrt(F.aggregate("w", F.lit(0.0), lambda s, x: s + x * x)))
    return rows.withColumn("u", F.transform("w", lambda x: x / F.col("norm")))


def nearest(df: DataFrame, asked: Column, key: str = "vec_id", vector: str = "embedding", k: int = K, sure: float = SURE) -> DataFrame:
    """(query_id, rank, <key>, score): for each row whose id meets ``asked``, the k nearest other rows found by cosine; ties to the smaller id."""
    rows = saved(usable(df, key, vector), "vectors")
    first = rows.withColumn("rank", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("rank") <= k + 1)
    nodes = first.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    nodes = saved(unit(nodes.select(F.col("ids")[0].alias("node"), "ids", "v")), "nodes")
    asks = rows.withColumnRenamed("id", key).where(asked).select(F.col(key).alias("id"), "v")
    asks = saved(asks.join(nodes.select("node", "v"), "v").select("id", "node"), "asks")
    queries = asks.select("node").distinct().join(nodes.select("node", "u"), "node")
    width = nodes.select(F.size("u")).head()
    if not width:
        return rows.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias(key), F.lit(0.0).alias("score")).limit(0)
    found = _nearest_classes(nodes, queries, width[0], k, sure).unionAll(queries.selectExpr("node query", "node"))
    side = lambda name: nodes.select(F.col("node").alias(name), F.col("w").alias(f"{name} w"), F.col("norm").alias(f"{name} norm"))
    pairs = found.join(side("query"), "query").join(side("node").join(nodes.select("node", "ids"), "node"), "node")
    dot = F.aggregate(F.zip_with("query w", "node w", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    pairs = pairs.withColumn("score", dot / (F.col("query norm") * F.col("node norm")))
    answers = saved(pairs.groupBy("query").agg(F.collect_list(F.struct("score", "ids")).alias("answers")), "answers")
    each = F.flatten(F.transform("answers", lambda a: F.transform(a["ids"], lambda i: F.struct((-a["score"]).alias("far"), i.alias("other")))))
    rows = asks.join(answers, asks["node"] == answers["query"]).select("id", F.slice(F.sort_array(F.filter(each, lambda a: a["other"] != F.col("id"))), 1, k).alias("best"))
    rows = rows.select(F.col("id").alias("query_id"), F.posexplode("best").alias("at", "a"))
    return rows.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("a.other").alias(key), (-F.col("a.far")).alias("score"))
