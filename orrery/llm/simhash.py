"""SimHash near-dedup with pivot distance tables.

A fingerprint's bit is 1 if it is set in over half of the XXH64 values (seed 42) of the text's three-word
shingles, repeats included. Two documents link if their fingerprints differ in at most three bits.

Pivots: a table holds each fingerprint's Hamming distances to many reference fingerprints. By the triangle
inequality two fingerprints differ in at least as many bits as any coordinate of theirs does, so a pair whose
largest coordinate difference is over three is discarded; only survivors are verified. Tables are sorted by their
first coordinate, which leaves out what is farther than three there. One coordinate discards only about half of
random pairs, so tables are made within bands, never over all fingerprints: the 64 bits are cut into six blocks, of which two linked fingerprints share at least three, and each fingerprint enters
the twenty bands that three blocks name (in general ``blocks`` less ``bits`` of them are shared). A band is walked breadth first and yields a spanning forest of its
links, so a large group of near copies gives as many rows as members, not their pairs.

Defined cases: null and empty texts have fingerprint zero and link like any other; fewer than three words
give one shingle of the whole sequence; equal fingerprints (ties, repeated rows) form one class before
links are sought; rows whose id is null get their fingerprint and no component; an empty table gives an empty one.

``similar_groups`` links by shingle similarity (Jaccard) instead: fingerprints only propose. They have 256 bits and
are made of the distinct shingles, so that a bit differs with probability acos(2J / (1 + J)) / pi at most. Each enters
bands of random bits; a band holds a few unrelated texts whatever the number of texts, and there are as many bands as
it takes to find a pair at the threshold with probability ``FOUND``. A band is walked in an order of its own, and a
text is proposed together with the one that it was reached from, if they differ in few of their first 128 bits; the
pivot table of the band's distances discards first. Sets
of shingles are compared exactly, pair by pair, and only those comparisons make links: first a text's nearest
proposal, then all proposals between groups that are still apart. No task holds a group; the texts proposed for one
text are split into blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from orrery.llm.batches import slices
from orrery.llm.components import components
from orrery.llm.shared import saved

WORDS, BITS, BLOCKS, PIVOTS = 3, 3, 6, 24
#: For similarity of 0.8: 64-bit lanes, the least bits of a band, the share of pairs to find, and the bits of the first
#: two lanes in which candidates may differ (19 expected at 0.8, standard deviation 4). ``tests/llm`` measures recall.
LEAST, LANES, BAND, FOUND, WITHIN = 0.8, 4, 16, 0.997, 32
#: Texts that are compared with one text by one task.
BLOCK = 256


def shingles(text: str | None, words: int = WORDS):
    """The shingles' hashes, repeats included."""
    import numpy as np
    from xxhash import xxh64_intdigest

    # bytes.lower() and bytes.split() know A-Z and \x20\x09-\x0D only
    found = (text or "").encode().lower().split()
    if not found:
        return np.zeros(0, "<u8")
    joined = b" ".join(found)
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = max(1, len(found) - words + 1)
    return np.fromiter([xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[min(words, len(found)) - 1 :].tolist())], "<u8", n)


def fingerprint(text: str | None, words: int = WORDS) -> int:
    return _majority(shingles(text, words))


def _majority(hashes) -> int:
    import numpy as np

    n = len(hashes)
    total = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 16):
        total += np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(total * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, text: str = "text", out: str = "fingerprint", words: int = WORDS, keep_text: bool = True) -> DataFrame:
    """df with ``out``: 16 lower-case hexadecimal digits."""
    left = [f for f in df.schema if f.name != out and (keep_text or f.name != text)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in slices(batches, text):
            found = pa.array([f"{fingerprint(t, words):016x}" for t in x.column(text).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(x.column(f.name) for f in left), found], names=[*(f.name for f in left), out])

    return df.mapInArrow(run, T.StructType([*left, T.StructField(out, T.StringType())]))


def _forest(ids, values, bits: int, refs, tally: list[int] | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among one band's fingerprints.

    The table is sorted by its first coordinate, so a fingerprint meets only those that may lie within ``bits`` of it
    there; the other coordinates discard of these, and only survivors are compared bit by bit. ``tally`` counts the
    pairs met, the pairs left by the table, and the links.
    """
    import numpy as np

    table = np.bitwise_count(values[:, None] ^ refs[None, :]).astype(np.int8)
    order = np.argsort(table[:, 0], kind="stable")
    ids, values, table = ids[order], values[order], table[order]
    low, high = np.searchsorted(table[:, 0], table[:, 0] - bits), np.searchsorted(table[:, 0], table[:, 0] + bits, side="right")
    rest, found = np.ones(len(ids), bool), []
    for first in range(len(ids)):
        if not rest[first]:
            continue
        rest[first], front = False, [first]
        while front:
            i = front.pop()
            met = low[i] + np.flatnonzero(rest[low[i] : high[i]])
            if len(met):
                left = met[(np.abs(table[met] - table[i]) <= bits).all(1)]
                near = left[np.bitwise_count(values[left] ^ values[i]) <= bits]
                rest[near] = False
                found += [(int(ids[i]), int(ids[j])) for j in near]
                front += near.tolist()
                if tally is not None:
                    tally[0], tally[1], tally[2] = tally[0] + len(met), tally[1] + len(left), tally[2] + len(near)
    return found


def _together(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[list]:
    """The columns of sorted batches, cut where ``by`` changes, so that equal values come together."""
    import numpy as np

    held: list[list] = []
    at = None
    for x in batches:
        if not x.num_rows:
            continue
        at = x.schema.get_field_index(by)
        cols = [c.to_numpy() for c in x.columns]
        cut = int(np.searchsorted(cols[at], cols[at][-1]))
        if cut:
            held.append([c[:cut] for c in cols])
        if held and (cut or held[-1][at][-1] != cols[at][-1]):
            yield [np.concatenate(c) for c in zip(*held)]
            held = []
        held.append([c[cut:] for c in cols])
    if held:
        yield [np.concatenate(c) for c in zip(*held)]


def _banded(batches: Iterator[pa.RecordBatch], links, names: tuple[str, ...] = ("a", "b")) -> Iterator[pa.RecordBatch]:
    """What links(columns) finds in each band of several rows."""
    import numpy as np

    for bands, *cols in _together(batches, "band"):
        at = np.flatnonzero(np.diff(bands, prepend=bands[:1] - 1))
        ends, edges = np.append(at[1:], len(bands)), []
        for a, b in zip(at[ends - at > 1], ends[ends - at > 1]):
            edges += links(*(c[a:b] for c in cols))
        yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in range(len(names))], names=names)


def links(nodes: DataFrame, bits: int = BITS, blocks: int = BLOCKS, pivots: int = PIVOTS) -> DataFrame:
    """Links (a, b) that connect the same nodes as all pairs of (node, value) within ``bits`` differing bits do."""
    cuts = [round(64 * k / blocks) for k in range(blocks + 1)]
    masks = [sum(((1 << cuts[k + 1]) - (1 << cuts[k])) for k in some) for some in combinations(range(blocks), blocks - bits)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    band = F.explode(F.array(*(F.xxhash64(F.lit(k), F.col("value").bitwiseAND(F.lit(m))) for k, m in enumerate(signed))))
    rows = nodes.select(band.alias("band"), "node", "value").repartition("band").sortWithinPartitions("band")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        refs = np.random.default_rng(64).integers(0, 1 << 64, pivots, dtype=np.uint64, endpoint=False)
        return _banded(batches, lambda ids, values: _forest(ids, values.view(np.uint64), bits, refs))

    return rows.mapInArrow(run, "a long, b long")


def near_groups(df: DataFrame, text: str = "text", key: str = "doc_id", words: int = WORDS, bits: int = BITS, blocks: int = BLOCKS) -> DataFrame:
    """(key, fingerprint, component_id) for each row; a component is named by its smallest key."""
    prints = saved(fingerprints(df.select(key, text), text, words=words, keep_text=False), "fingerprints")
    classes = saved(prints.groupBy("fingerprint").agg(F.min(key).alias("node")), "classes")
    # conv() yields the unsigned number in decimal; two halves make the signed long with the same bits
    half = lambda k: F.conv(F.substring("fingerprint", k, 8), 16, 10).cast("long")
    nodes = classes.where("node is not null").select("node", F.shiftleft(half(1), 32).bitwiseOR(half(9)).alias("value"))
    found = components(links(nodes, bits, blocks))
    named = saved(classes.join(found, "node", "left").select("fingerprint", F.coalesce("component", "node").alias("component_id")), "named")
    return prints.join(named, "fingerprint").select(key, "fingerprint", F.when(F.col(key).isNotNull(), F.col("component_id")).alias("component_id"))


def _distinct(text: str | None, words: int):
    """The sorted set of a text's shingles."""
    import numpy as np

    return np.unique(shingles(text, words))


def _lane(hashes, k: int):
    """The shingles' hashes for one lane of the fingerprint."""
    import numpy as np

    if not k:
        return hashes
    h = (hashes ^ np.uint64(0x9E3779B97F4A7C15 * (2 * k + 1) & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _same(found) -> bytes:
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(found.tobytes())


def bands(n: int, least: float = LEAST, found: float = FOUND, low: int = BAND) -> tuple[int, int]:
    """The bits of a band, so that unrelated texts are few in it, and how many bands find a pair of similarity ``least``."""
    bits = max(low, math.ceil(math.log2(max(2, n))) - 4)
    agree = (1 - math.acos(2 * least / (1 + least)) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - found) / math.log(1 - agree))


def _near(ids, a, b, tally: list[int] | None = None) -> list[tuple[int, int, int]]:
    """Links (a, b, apart) that connect a band's fingerprints within WITHIN bits. The pivot table discards first, as in _forest; ``tally`` counts the pairs met and those left by the table."""
    import numpy as np

    rest, found = np.arange(len(ids)), []
    if len(ids) > 2:  # the band's first members are the pivots: unrelated ones are half the bits away from random pivots, and so alike there
        table = np.bitwise_count(a[:, None] ^ a[None, :PIVOTS]).astype(np.int16) + np.bitwise_count(b[:, None] ^ b[None, :PIVOTS])
    while len(rest) > 1:
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            i = front.pop()
            left = (np.abs(table[rest] - table[i]) <= WITHIN).all(1) if len(ids) > 2 else np.ones(len(rest), bool)
            if tally is not None:
                tally[0], tally[1] = tally[0] + len(rest), tally[1] + int(left.sum())
            if left.any():  # what the table discards is never compared
                some = rest[left]
                apart = np.bitwise_count(a[some] ^ a[i]).astype(np.int16) + np.bitwise_count(b[some] ^ b[i])
                hit = apart <= WITHIN
                found += [(min(int(ids[i]), int(ids[j])), max(int(ids[i]), int(ids[j])), int(d)) for j, d in zip(some[hit], apart[hit])]
                front += some[hit].tolist()
                left[left] = hit
                rest = rest[~left]
    return found


def _candidates(nodes: DataFrame, bits: int, count: int) -> DataFrame:
    """Proposals (a, b, apart) that connect nodes (node, f0, f1, ...) whose fingerprints share a band and are close."""
    each = 64 * LANES // bits

    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        rng = np.random.default_rng(80)
        places = np.concatenate([rng.permutation(64 * LANES)[: each * bits].reshape(-1, bits) for _ in range(-(-count // each))])[:count]
        for batch in batches:
            for x in (batch.slice(k, 1000) for k in range(0, batch.num_rows, 1000)):
                lanes = np.stack([x.column(f"f{k}").to_numpy() for k in range(LANES)], axis=1)
                ones = np.unpackbits(np.ascontiguousarray(lanes).view(np.uint8).reshape(len(lanes), -1), axis=1, bitorder="little").astype(np.int64)
                for k, some in enumerate(places):
                    band = ones[:, some] @ (1 << np.arange(bits)) | k << bits
                    yield pa.RecordBatch.from_arrays([pa.array(band), x.column("node"), x.column("f0"), x.column("f1")], names=["band", "node", "f0", "f1"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        return _banded(batches, lambda ids, a, b: _near(ids, a.view(np.uint64), b.view(np.uint64)), ("a", "b", "apart"))

    rows = nodes.mapInArrow(banded, "band long, node long, f0 long, f1 long")
    found = rows.repartition("band").sortWithinPartitions("band", F.xxhash64("node", "band")).mapInArrow(run, "a long, b long, apart long")
    return found.groupBy("a", "b").agg(F.min("apart").alias("apart"))


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sets (node, shingles) are ``least`` similar. Those of one a are compared in blocks."""
    counts = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    # saved, since heads and partners both start from it
    rows = saved(pairs.join(counts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int").alias("block")), "blocks")
    heads = rows.select("a", "block").distinct().join(sets.withColumnRenamed("node", "a"), "a").select("a", "block", F.lit(None).cast("long").alias("b"), "shingles")
    rows = heads.unionByName(rows.join(sets.withColumnRenamed("node", "b"), "b").select("a", "block", "b", "shingles"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        own = None
        for batch in batches:
            found = []
            for a, b, s in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("shingles")):
                s = np.frombuffer(s.as_buffer(), "<u8")
                if b is None:
                    own = s
                else:
                    common = len(np.intersect1d(own, s, assume_unique=True)) if 5 * min(len(s), len(own)) >= 5 * least * max(len(s), len(own)) - 1e-9 else 0
                    if common and common >= least * (len(own) + len(s) - common) - 1e-9:
                        found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return rows.repartition("a", "block").sortWithinPartitions("a", "block", F.col("b").asc_nulls_first()).mapInArrow(run, "a long, b long")


def similar_groups(df: DataFrame, text: str = "text", key: str = "doc_id", words: int = WORDS, least: float = LEAST) -> DataFrame:
    """(key, component_id) for each row: the components of the links between texts whose sets of shingles are ``least`` similar.

    Equal sets form one class before links are sought, empty ones too; rows whose id is null get no component. Rows that share an id have each the component of their own text.
    """
    return _grouped(df, text, key, words, least).select(key, "component_id")


def copies(df: DataFrame, text: str = "text", key: str = "doc_id", words: int = WORDS, least: float = LEAST) -> DataFrame:
    """(key, digest, n_rows, kept) for each id and text (by its MD5): whether it is the one of its component that stays, the smallest id, then digest. Rows without an id aren't listed."""
    rows = _grouped(df, text, key, words, least).where(F.col(key).isNotNull()).groupBy(key, "digest", "component").agg(F.count("*").alias("n_rows"))
    rows = saved(rows, "rows")
    first = rows.groupBy("component").agg(F.min(F.struct(key, "digest")).alias("first"))
    return rows.join(saved(first, "first"), "component").select(key, "digest", "n_rows", (F.struct(key, "digest") == F.col("first")).alias("kept"))


def _grouped(df: DataFrame, text: str, key: str, words: int, least: float) -> DataFrame:
    """(key, digest, component, component_id) for each row."""
    lanes = [f"f{k}" for k in range(LANES)]

    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for x in slices(batches, text):
            sets = [_distinct(t, words) for t in x.column(text).to_pylist()]
            found = [pa.array(np.array([_majority(_lane(s, k)) for s in sets], np.uint64).view(np.int64)) for k in range(LANES)]
            yield pa.RecordBatch.from_arrays([x.column(key), x.column("digest"), pa.array(map(_same, sets), pa.binary()), *found], names=[key, "digest", "same", *lanes])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in slices(batches, text, most=1 << 20):
            sets = [_distinct(t, words) for t in x.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([x.column("least"), pa.array(map(_same, sets), pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["least", "same", "shingles"])

    kinds = T.StructType([df.schema[key], T.StructField("digest", T.StringType()), T.StructField("same", T.BinaryType()), *(T.StructField(f, T.LongType()) for f in lanes)])
    prints = saved(df.select(key, F.md5(F.coalesce(text, F.lit(""))).alias("digest"), text).mapInArrow(printed, kinds), "fingerprints")
    # several classes may have the same smallest id, so each has a number of its own
    classes = prints.groupBy("same").agg(F.min(key).cast("long").alias("least"), *(F.min(f).alias(f) for f in lanes))
    classes = saved(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    nodes = classes.where("least is not null")
    pairs = saved(_candidates(nodes.select("node", *lanes), *bands(nodes.count(), least)), "candidates")
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(nodes.select("node", "least"), "node").select("least").distinct()
    texts = df.select(F.col(key).cast("long").alias("least"), F.col(text)).join(ends.hint("shuffle_hash"), "least")
    sets = texts.mapInArrow(listed, "least long, same binary, shingles binary")
    # an id that has several texts names the class of one of them at least, and may name more
    sets = saved(sets.join(nodes.select("node", "least", "same"), ["least", "same"]).dropDuplicates(["node"]).select("node", "shingles"), "sets")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "apart"))
    nearest = both.groupBy("a").agg(F.min(F.struct("apart", F.xxhash64("a", "b").alias("h"), "b")).alias("m")).select(F.least("a", "m.b").alias("a"), F.greatest("a", "m.b").alias("b")).distinct()
    first = saved(_verified(nearest, sets, least), "links")
    parts = saved(components(first), "parts")
    part = lambda c: parts.select(F.col("node").alias(c), F.col("component").alias(f"{c} part"))
    apart = pairs.join(nearest, ["a", "b"], "left_anti").join(part("a"), "a", "left").join(part("b"), "b", "left")
    apart = apart.where(F.coalesce("a part", "a") != F.coalesce("b part", "b")).select("a", "b")
    links = first.unionByName(saved(_verified(saved(apart, "apart"), sets, least), "links"))
    named = saved(classes.join(components(links), "node", "left").select("same", "least", F.coalesce("component", "node").alias("component")), "named")
    named = named.join(saved(named.groupBy("component").agg(F.min("least").alias("component_id")), "smallest"), "component")
    return prints.join(saved(named, "named"), "same").select(key, "digest", "component", F.when(F.col(key).isNotNull(), F.col("component_id")).alias("component_id"))
