"""Embedding near-dedup by NN-descent.

The neighbour graph starts from random orders: vectors are sorted by the signs of random projections, and
each gets its best neighbours among those that lie in the same short run. There are as many orders as it takes for a
pair at the threshold to share a run with probability ``MEET``, which the number of vectors tells: it falls with a
small power of that. A round then compares the neighbours (and reverse neighbours) of every vector with each other and keeps the best of what it found.
Lists that are full of links are enlarged to twice their length for the next round. Only pairs that are
close enough to lie on a path of two links are worth keeping, so vectors without near neighbours drop out.

The graph's links give the components; within each of them all links are counted exactly, by pairs of
hashed blocks of bounded size, so lists never cap a count. Lists stop at ``FULL`` times their length; what a
list that is full then may lack is sought exactly: a component that holds such a vector is compared with every
vector near enough to its centre, given its radius, to link with a member. An audit compares a set of vectors
with all others by brute force: some that have near neighbours and some of all, four times as many until they have
``TRUE`` links, all vectors are among them, or they are ``MOST``. While its recall is below the target, more random
orders and rounds are added, and after ``ATTEMPTS`` of them the job fails.

Defined cases: null, empty and zero vectors, and vectors with null or non-finite components, link with
nothing and are kept; so do vectors whose length differs from the table's commonest (ties: the longest);
equal vectors form one class before the search, so copies are never expanded into pairs; rows whose id is
null are left out; rows that share an id count as one vector, the one that sorts first; an empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from orrery.llm.components import components
from orrery.llm.shared import saved

LINK, LIST, ORDERS, ROUNDS, RUN, BLOCK, FULL, ATTEMPTS, MEET = 0.95, 12, 6, 3, 96, 256, 4, 8, 0.99
#: Centres of a block that meets a block of vectors, eight times as large.
CENTRES = 1024
#: The audit: so many vectors against all at first and at most, the links wanted of them, and the share of these that must be found.
AUDIT, MOST, TRUE, RECALL = 256, 8192, 200, 0.98


def orders_for(n: int, link: float = LINK, meet: float = MEET) -> int:
    """How many random orders of n vectors bring a pair at the threshold into one run: it has to agree in the bits that tell n / RUN
    runs apart, and not to lie on two sides of a border."""
    bits = max(0.0, math.log2(max(1, n / RUN)))
    share = 0.6 * (1 - math.acos(link) / math.pi) ** bits
    return math.ceil(math.log(1 - meet) / math.log(1 - share))


def _matrix(column: pa.Array):
    import numpy as np

    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def _floor(link: float) -> float:
    """The least cosine between the ends of a path of two links."""
    return math.cos(2 * math.acos(link))


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v): the vectors that can link."""
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id is not null and size(v) > 0")
    rows = rows.where("forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")
    rows = rows.groupBy("id").agg(F.min("v").alias("v"))
    width = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).select("n").head()
    return rows.where(F.size("v") == (width[0] if width else 0))


def classes(rows: DataFrame) -> DataFrame:
    """(node, size, v, u): the classes of equal vectors v, named by their smallest id, with the unit vector u."""
    largest = F.array_max(F.transform("v", F.abs))  # scaling first keeps squares in range
    scaled = F.transform("v", lambda x: x / largest)
    norm = F.sqrt(F.aggregate("scaled", F.lit(0.0), lambda s, x: s + x * x))
    found = rows.groupBy("v").agg(F.min("id").alias("node"), F.count("*").alias("size")).withColumn("scaled", scaled)
    return found.select("node", "size", "v", F.transform("scaled", lambda x: x / norm).alias("u"))


def _best(pairs: DataFrame, lists: DataFrame | None, length: int) -> DataFrame:
    """The best pairs of each node, as many as its list holds."""
    from pyspark.sql import Window

    unique = pairs.groupBy("a", "b").agg(F.max("sim").alias("sim"))
    # no list holds more than FULL times the length, so tasks send no more of a hub's pairs to its window
    ranked = unique.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), "b"))).where(F.col("rank") <= FULL * length)
    if lists is None:
        ranked = ranked.withColumn("room", F.lit(length))
    else:
        ranked = ranked.join(lists.withColumnRenamed("node", "a"), "a", "left").withColumn("room", F.coalesce("room", F.lit(length)))
    return ranked.where("rank <= room").select("a", "b", "sim", "room")


def _from_orders(nodes: DataFrame, seed: int, orders: int, length: int, floor: float, bits: int = 20) -> DataFrame:
    """Pairs (a, b, sim) among the vectors of short runs of random orders, the best of each run's members."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for x in batches:
            if x.num_rows:
                v = _matrix(x.column("u"))
                for r in range(orders):
                    planes = np.random.default_rng((seed, r)).standard_normal((v.shape[1], bits))
                    code = ((v @ planes) > 0) @ (1 << np.arange(bits))[::-1]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), r, np.int32)), pa.array(code), x.column("node"), x.column("u")], names=["r", "code", "node", "u"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for x in batches:
            for k in range(0, x.num_rows, RUN):
                part = x.slice(k, RUN)
                ids, order, v = part.column("node").to_numpy(), part.column("r").to_numpy(), _matrix(part.column("u"))
                yield _close(ids, v, length, floor, order[:, None] == order[None, :])

    rows = nodes.select("node", "u").mapInArrow(coded, "r int, code long, node long, u array<double>")
    return rows.repartitionByRange("r", "code", "node").sortWithinPartitions("r", "code", "node").mapInArrow(compared, "a long, b long, sim double")


def _close(ids, v, length: int, floor: float, allowed=None) -> pa.RecordBatch:
    import numpy as np

    s = v @ v.T
    s[ids[:, None] == ids[None, :]] = -2
    if allowed is not None:
        s[~allowed] = -2
    if len(ids) > length:
        top = np.partition(s, len(ids) - length, axis=1)[:, len(ids) - length]
        i, j = np.nonzero((s >= floor) & (s >= top[:, None]))
    else:
        i, j = np.nonzero(s >= floor)
    return pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(ids[j]), pa.array(s[i, j])], names=["a", "b", "sim"])


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys of batches that are sorted by them."""
    import numpy as np

    held = None
    for x in batches:
        now = pa.Table.from_batches([x])
        now = pa.concat_tables([held, now]).combine_chunks() if held is not None else now
        if not now.num_rows:
            continue
        change = np.zeros(now.num_rows - 1, bool)
        for k in keys:
            change |= np.diff(now.column(k).to_numpy()) != 0
        cuts = [0, *(np.flatnonzero(change) + 1).tolist()]
        for a, b in zip(cuts, cuts[1:]):
            yield now.slice(a, b - a)
        held = now.slice(cuts[-1])
    if held is not None and held.num_rows:
        yield held


def _round(nodes: DataFrame, graph: DataFrame, length: int, floor: float) -> DataFrame:
    """Pairs among the neighbours and reverse neighbours of each vector. The literal limit lets tasks cut a hub's rows before the shuffle."""
    from pyspark.sql import Window

    back = graph.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim", "room").withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), "b")))
    back = back.where(F.col("rank") <= FULL * length).where("rank <= room")
    members = graph.select("a", "b", "room").unionAll(back.select("a", "b", "room")).groupBy("a", "b").agg(F.max("room").alias("room"))
    members = members.unionAll(graph.groupBy("a").agg(F.max("room").alias("room")).selectExpr("a", "a b", "room"))
    rows = members.join(nodes.select(F.col("node").alias("b"), "u"), "b").select("a", "b", "room", "u")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, ["a"]):
            g = g.combine_chunks()
            yield _close(g.column("b").to_numpy(), _matrix(g.column("u").combine_chunks()), max(g.column("room").to_pylist()), floor)

    return rows.repartition("a").sortWithinPartitions("a").mapInArrow(run, "a long, b long, sim double")


def _across(nodes: DataFrame, parts: DataFrame, full: DataFrame, link: float) -> DataFrame:
    """Pairs (a, b) of components, one of them with a node of ``full``, that may have a link. A node outside all parts is its own."""
    dense = parts.join(parts.join(full, "node").select("component").distinct(), "component").join(nodes.select("node", "u"), "node")
    sums = dense.select("component", F.posexplode("u").alias("k", "x")).groupBy("component", "k").agg(F.avg("x").alias("x"))
    centres = saved(sums.groupBy("component").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("c")), "centres")
    gap = F.sqrt(F.aggregate(F.zip_with("u", "c", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda t, x: t + x))
    # linked unit vectors are at most so far apart, so one that links with a member is no farther from its centre than that and the radius
    reach = F.max(gap) + math.sqrt(2 - 2 * link) + 1e-9
    centres = saved(dense.join(centres, "component").groupBy("component").agg(F.first("c").alias("u"), reach.alias("reach")), "reach")
    if not (n := centres.count()):
        return parts.selectExpr("node a", "component b").limit(0)
    # blocks of centres meet blocks of vectors; both are dealt by hash
    blocks, salts = -(-n // CENTRES), -(-nodes.count() // (8 * CENTRES))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = centres.select(dealt("component", blocks).alias("block"), every(salts).alias("salt"), F.lit(0).alias("kind"), "component", "u", "reach")
    rows = nodes.join(parts, "node", "left").select("node", F.coalesce("component", "node").alias("component"), "u")
    rows = left.unionAll(rows.select(every(blocks).alias("block"), dealt("node", salts).alias("salt"), F.lit(1).alias("kind"), "component", "u", F.lit(0.0).alias("reach")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for g in _groups(batches, ["block", "salt"]):
            g = g.combine_chunks()
            kind, ids, u, far = g.column("kind").to_numpy(), g.column("component").to_numpy(), _matrix(g.column("u").combine_chunks()), g.column("reach").to_numpy()
            k = int((kind == 0).sum())
            for at in range(k, len(ids), 512):
                v, own = u[at : at + 512], ids[at : at + 512]
                square = (v * v).sum(1)[:, None] + (u[:k] * u[:k]).sum(1)[None, :] - 2 * (v @ u[:k].T)
                i, j = np.nonzero((square <= (far[:k] * far[:k])[None, :] + 1e-9) & (own[:, None] != ids[None, :k]))
                yield pa.RecordBatch.from_arrays([pa.array(own[i]), pa.array(ids[j])], names=["a", "b"])

    return rows.repartition("block", "salt").sortWithinPartitions("block", "salt", "kind").mapInArrow(run, "a long, b long").distinct()


def _counts(nodes: DataFrame, parts: DataFrame, link: float) -> DataFrame:
    """(node, links, other): the vectors linked to each node of a component, its own class aside; and, with no count, links from its part to another part.

    parts has (node, component, part): nodes of a component are compared, whatever their parts.
    """
    sizes = saved(parts.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "sizes")
    rows = parts.join(nodes, "node").select("node", "component", "part", "size", "u").join(sizes, "component")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select(F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "component", "part", "own", "node", "size", "u")
    keys = ["component", "lo", "hi"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for g in _groups(batches, keys):
            g = g.combine_chunks()
            ids, size, v = g.column("node").to_numpy(), g.column("size").to_numpy(), _matrix(g.column("u").combine_chunks())
            own, lo, hi = g.column("own").to_numpy(), g.column("lo")[0].as_py(), g.column("hi")[0].as_py()
            part, pairs = g.column("part").to_numpy(), set()
            out = np.zeros(len(ids), np.int64)
            for k in range(0, len(ids), 512):  # blocks are hashed, so a few are larger than planned
                near = v[k : k + 512] @ v.T >= link
                if lo != hi:
                    near &= own[k : k + 512, None] != own[None, :]
                near &= ids[k : k + 512, None] != ids[None, :]
                out[k : k + 512] = near @ size
                i, j = np.nonzero(near & (part[k : k + 512, None] < part[None, :]))
                pairs.update(zip(part[i + k].tolist(), part[j].tolist()))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(out), pa.nulls(len(ids), pa.int64())], names=["node", "n", "other"])
            pairs = sorted(pairs)
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], pa.int64()), pa.nulls(len(pairs), pa.int64()), pa.array([b for _, b in pairs], pa.int64())], names=["node", "n", "other"])

    found = rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "node long, n long, other long")
    return found.groupBy("node", "other").agg(F.sum("n").alias("links"))


def _audit(nodes: DataFrame, counts: DataFrame, near: DataFrame, link: float, size: int) -> tuple[float, int]:
    """The share found of the links of at most ``size`` vectors, those that come first by a hash, and half as many of ``near``; and how many links these are."""
    hashed = nodes.select("node", "u", F.xxhash64("node", F.lit(1)).alias("h"))
    few = hashed.join(near, "node", "left_semi").orderBy("h").limit(size // 2)
    some = hashed.orderBy("h").limit(size).unionAll(few).dropDuplicates(["node"]).collect()
    ids, queries = [r["node"] for r in some], [list(r["u"]) for r in some]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        q, own, total = np.array(queries), np.array(ids), np.zeros(len(ids), np.int64)
        for batch in batches:
            for x in (batch.slice(k, 1024) for k in range(0, batch.num_rows, 1024)):
                u, node, size = _matrix(x.column("u")), x.column("node").to_numpy(), x.column("size").to_numpy()
                for k in range(0, len(own), 1024):
                    part = slice(k, k + 1024)
                    total[part] += size @ ((u @ q[part].T >= link) & (node[:, None] != own[part]))
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(total)], names=["node", "n"])

    true = nodes.mapInArrow(run, "node long, n long").groupBy("node").agg(F.sum("n").alias("n"))
    found = true.join(counts, "node", "left").agg(F.sum("n").alias("n"), F.sum(F.least("n", F.coalesce("links", F.lit(0)))).alias("found")).first()
    return (found["found"] / found["n"], found["n"]) if found["n"] else (1.0, 0)


def near_groups(df: DataFrame, key: str = "vec_id", vector: str = "embedding", link: float = LINK, length: int = LIST, orders: int = ORDERS, rounds: int = ROUNDS, recall: float = RECALL) -> DataFrame:
    """(key, n_links, component_id, kept) for each row whose key isn't null."""
    floor = _floor(link)
    rows = usable(df, key, vector)
    nodes = saved(classes(rows), "vectors")
    graph = None
    lists = lambda: graph.groupBy(F.col("a").alias("node")).agg(F.max("room").alias("room"), F.count("*").alias("n"), F.min("sim").alias("least"))
    is_full = (F.col("n") >= F.col("room")) & (F.col("least") >= link)
    total = nodes.count()
    bits = min(62, max(20, math.ceil(math.log2(max(2, total / RUN))) + 8))
    seed = 0
    for attempt in range(ATTEMPTS):
        for _ in range(1 if attempt else max(1, -(-orders_for(total, link) // orders))):
            found = _from_orders(nodes, seed, orders, length, floor, bits)
            graph = saved(_best(found, None, length) if graph is None else _best(found.unionAll(graph.select("a", "b", "sim")), lists().select("node", "room"), length), "graph")
            seed += 1
        for _ in range(rounds):
            room = lists().select("node", F.when(is_full, F.least(2 * F.col("room"), F.lit(FULL * length))).otherwise(F.col("room")).alias("room"))
            better = saved(_best(_round(nodes, graph, length, floor).unionAll(graph.select("a", "b", "sim")), room, length), "graph")
            new = better.where(F.col("sim") >= link).join(graph, ["a", "b"], "left_anti").count()
            graph = better
            if not new:
                break
        links = graph.where(F.col("sim") >= link).select("a", "b")
        parts = saved(components(links), "parts")
        across = saved(_across(nodes, parts, saved(lists().where(is_full).select("node"), "full"), link), "across")
        # components that may be linked are compared as one; then links found between them join them
        joined = components(across).toDF("part", "wider")
        wider = nodes.select("node").join(parts, "node", "left").select("node", F.coalesce("component", "node").alias("part")).join(joined, "part", "left")
        wider = saved(wider.select("node", F.coalesce("wider", "part").alias("component"), "part").join(parts.select("node").union(joined.select("part")).distinct(), "node"), "wider")
        both = saved(_counts(nodes, wider, link), "counts")
        counts = both.where("other is null").select("node", "links")
        met = both.where("other is not null").selectExpr("node a", "other b")
        if not met.isEmpty():
            parts = saved(components(links.unionAll(met)), "parts")
        size, near = AUDIT, graph.select(F.col("a").alias("node")).distinct()
        reached, true = _audit(nodes, counts, near, link, size)
        while true < TRUE and size < min(total, MOST):
            size = min(4 * size, MOST)
            reached, true = _audit(nodes, counts, near, link, size)
        if reached >= recall:
            break
    else:
        raise RuntimeError(f"the audit found {reached:.3f} of the links after {ATTEMPTS} attempts, under {recall}")
    named = nodes.select("node", "size").join(counts, "node", "left").join(parts, "node", "left")
    named = named.select("node", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    named = saved(named.join(nodes.select("node", "v"), "node").drop("node"), "named")
    members = rows.join(named, "v").select(F.col("id").alias(key), "n_links", "component_id")
    out = df.select(F.col(key).cast("long").alias(key)).where(F.col(key).isNotNull()).distinct().join(members, key, "left")
    out = out.select(key, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", F.col(key)).alias("component_id"))
    return out.withColumn("kept", F.col(key) == F.col("component_id"))
