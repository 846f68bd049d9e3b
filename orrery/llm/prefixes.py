"""The prefix trie of conversations, from sorted neighbours and union-find.

A conversation is a sequence of turns; a turn is known by a digest of its role and text. Equal sequences form one class.
Classes are sorted by their digests and dealt by range, so that conversations with a common beginning are neighbours.
A chunk of neighbours gives one edge for each two of them: the length of their longest common prefix. Union-find takes
the edges in descending depth; where components merge, a node of the trie branches, and the turns between it and what it
joins are the nodes on the way. What a chunk can't close is what its first and last conversation may share with the chunks
beside it: the nodes on these two paths. They stay open and are contracted to two sequences, which carry sums of what hangs
from them; the sequences of all chunks are sorted and merged in the same way, until one chunk holds them all.

A chunk holds at most ``CHUNK`` bytes of digests (or eight longer sequences); a common beginning, many copies and frequent
turns are cut by chunks like all else. A conversation is one row of some 20 bytes a turn. Identifiers that end at a node
are hashed in their order: by blocks first, then one task for each node goes over its blocks, as SHA-256 asks for.

Defined cases: rows without a conversation's id belong to none and are left out; null turns come first; rows with equal
turns are ordered by role and then by the text's MD5, and repeated rows are turns of their own; null role or text
becomes empty; further columns don't matter; an empty table gives an empty one (no conversation, no root).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from orrery.llm.batches import give_back, slices
from orrery.llm.shared import saved

#: Bytes of digests in a chunk, of identifiers in a block, and sequences that one task merges at the end.
CHUNK, BLOCK, LAST = 4 << 20, 1 << 13, 20_000
#: Conversations of a family begin with the turns of its first one: at most SHARED - 1 of them.
FAMILY, SHARED, DIGEST = 100, 6, 16
NO_ENDS = hashlib.sha256(b"").hexdigest()
HANG = "array<struct<depth:int, n:long, least:long, children:long, leaves:long, saved:long, ends:string>>"


def sequences(df: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, turns): each conversation's turns (digest, length) in order."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.encode(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), "UTF-8")))
    turn = F.struct(F.col("turn"), role.alias("role"), F.md5(F.encode(text, "UTF-8")).alias("order"), digest.alias("digest"), F.length(text).alias("length"))
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias(key), turn.alias("t"))
    return rows.groupBy(key).agg(F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["digest"].alias("digest"), t["length"].alias("length"))).alias("turns"))


def shared_turns(key: Column) -> Column:
    """How many turns a conversation takes from the first of its family."""
    return (F.crc32(F.encode(key.cast("string"), "UTF-8")) % SHARED).cast("int")


def rebuilt(df: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, turns): each conversation's first turns are those of its family's first conversation, if there is one; its own further ones follow."""
    found = saved(sequences(df, key), "sequences")
    first = found.where(F.col(key) % FAMILY == 0).select(F.col(key).alias("family"), F.slice("turns", 1, SHARED - 1).alias("beginning"))
    rows = found.withColumn("family", F.col(key) - F.col(key) % FAMILY).join(first, "family", "left")
    h = shared_turns(F.col(key))
    none = F.expr("cast(array() as array<struct<digest:binary,length:int>>)")
    own = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    return rows.select(key, F.concat(F.slice(F.coalesce("beginning", none), F.lit(1), h), own).alias("turns"))


def _packed(turns: str) -> Column:
    return F.unhex(F.array_join(F.transform(turns, lambda t: F.hex(t["digest"])), ""))


def classes(convs: DataFrame, key: str = "conv_id") -> DataFrame:
    """(path, lengths, hang): the distinct sequences, what hangs from their last node, and the hash of the ids that end there."""
    rows = convs.select(F.col(key).alias("conv"), _packed("turns").alias("path"), F.transform("turns", lambda t: t["length"]).alias("lengths"))
    rows = saved(rows.withColumn("name", F.md5("path")), "paths")
    found = saved(rows.groupBy("name").agg(F.any_value("path").alias("path"), F.any_value("lengths").alias("lengths"), F.count("*").alias("n"), F.min("conv").alias("least")), "classes")
    copied = rows.select("name", "conv").join(found.where("n > 1").select("name"), "name", "left_semi")
    zero = F.lit(0).cast("long")
    ends = F.coalesce("ends", F.sha2(F.encode(F.col("least").cast("string"), "UTF-8"), 256)).alias("ends")
    hang = F.struct(F.size("lengths").alias("depth"), "n", "least", zero.alias("children"), zero.alias("leaves"), zero.alias("saved"), ends)
    return found.join(_hashed(copied), "name", "left").select("path", "lengths", F.array(hang).cast(HANG).alias("hang"))


def _hashed(rows: DataFrame) -> DataFrame:
    """(name, ends): SHA-256 over each name's conv in ascending order, comma-joined. Blocks of text are made where the rows lie, and read one after the other."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first, held, size = None, None, [], 0

        def block():
            return pa.RecordBatch.from_arrays([pa.array([now]), pa.array([first], pa.int64()), pa.array([",".join(held)])], names=["name", "first", "block"])

        for x in batches:
            for name, conv in zip(x.column("name").to_pylist(), x.column("conv").to_pylist()):
                if held and (name != now or size > BLOCK):
                    yield block()
                    held, size = [], 0
                if not held:
                    now, first = name, conv
                held.append(str(conv))
                size += len(held[-1]) + 1
        if held:
            yield block()

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for x in batches:
            names, out = [], []
            for name, block in zip(x.column("name").to_pylist(), x.column("block").to_pylist()):
                if name != now:
                    if now is not None:
                        names.append(now), out.append(state.hexdigest())
                    now, state = name, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(block.encode())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(out, pa.string())], names=["name", "ends"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([state.hexdigest()])], names=["name", "ends"])

    dealt = rows.select("name", "conv").repartitionByRange("name", "conv").sortWithinPartitions("name", "conv")
    parts = dealt.mapInArrow(blocks, "name string, first long, block string")
    return parts.repartition("name").sortWithinPartitions("name", "first").mapInArrow(joined, "name string, ends string")


class _Forest:
    """The components of one chunk's sequences. ``whole`` says that no other chunk exists, so that all nodes close."""

    def __init__(self, paths: list[bytes], lengths: list[list[int]], hangs: list[list[dict]], whole: bool, named: bool):
        self.paths, self.lengths, self.whole, self.named = paths, lengths, whole, named
        self.parent = list(range(len(paths)))
        #: Of each component: a sequence that runs through its top, the depth of that, what hangs from which depth, and nodes whose parent is to be named.
        self.top = [len(x) for x in lengths]
        self.hang = [{h["depth"]: [h["n"], h["least"], h["children"], h["leaves"], h["saved"], h["ends"]] for h in hs} for hs in hangs]
        self.waiting: list[dict[int, list[int]]] = [{} for _ in paths]
        self.nodes: list[list] = []

    def find(self, k: int) -> int:
        while self.parent[k] != k:
            self.parent[k] = self.parent[self.parent[k]]
            k = self.parent[k]
        return k

    def close(self, c: int, above: int) -> None:
        """Closes the nodes of a component from its top down to a depth of above + 1; what they sum up to hangs from ``above``."""
        hang, waiting, lengths = self.hang[c], self.waiting[c], self.lengths[c]
        names = _prefixes(self.paths[c][: DIGEST * self.top[c]]) if self.named else None
        n, least, leaves, saved, below = 0, None, 0, 0, None
        for d in range(self.top[c], above, -1):
            own = hang.pop(d, None) or [0, None, 0, 0, 0, None]
            n += own[0]
            least = own[1] if least is None else least if own[1] is None else min(least, own[1])
            children, leaves, saved = own[2] + (below is not None), leaves + own[3], saved + own[4]
            leaves += not children
            saved += (n - 1) * lengths[d - 1] if d else 0
            for k in [*waiting.pop(d, ()), *([below] if below is not None else [])]:
                self.nodes[k][2] = least
            below = len(self.nodes)
            self.nodes.append([d, least, None, n, children, leaves, saved, own[5], None, names and names[d]])
        if below is not None and above >= 0:
            _add(hang.setdefault(above, [0, None, 0, 0, 0, None]), [n, least, 1, leaves, saved, None])
            waiting.setdefault(above, []).append(below)
        self.top[c] = above

    def merge(self, a: int, b: int, depth: int, sides: tuple[dict, dict]) -> None:
        """Joins the components of two neighbours at the depth of their common prefix."""
        a, b = self.find(a), self.find(b)
        first, last = self.find(0), self.find(len(self.paths) - 1)
        for c in (a, b):
            if self.top[c] > depth and (self.whole or c not in (first, last)):
                self.close(c, depth)
        if not self.whole:  # an open path stays: what hangs deeper than the merge is kept apart, with its waiting nodes
            for c, side in ((first, sides[0]), (last, sides[1])):
                if c in (a, b):
                    for kept, held in zip(side, (self.hang[c], self.waiting[c])):
                        kept.update({d: held.pop(d) for d in [d for d in held if d > depth]})
        for d, h in self.hang[b].items():
            _add(self.hang[a].setdefault(d, [0, None, 0, 0, 0, None]), h)
        for d, ks in self.waiting[b].items():
            self.waiting[a].setdefault(d, []).extend(ks)
        self.parent[b], self.top[a] = a, depth
        self.hang[b], self.waiting[b] = {}, {}

    def grow(self) -> list[tuple[int, list[dict]]]:
        """Takes the edges in descending depth. Returns the two open sequences, each with what hangs from it."""
        m = len(self.paths)
        edges = sorted(((_common(self.paths[k], self.paths[k + 1]), k) for k in range(m - 1)), key=lambda e: (-e[0], e[1]))
        sides = ({}, {}), ({}, {})
        for depth, k in edges:
            self.merge(k, k + 1, depth, sides)
        root = self.find(0)
        if self.whole:
            self.close(root, -1)
            return []
        for kept, held in zip(sides[0], (self.hang[root], self.waiting[root])):
            kept.update(held)
        out = []
        for at, (hang, waiting) in zip((0, m - 1)[: min(m, 2)], sides):
            names = _prefixes(self.paths[at])
            for d, ks in waiting.items():
                for k in ks:
                    self.nodes[k][8] = names[d]
            out.append((at, [dict(zip(("depth", "n", "least", "children", "leaves", "saved", "ends"), (d, *h))) for d, h in sorted(hang.items())]))
        return out


def _add(to: list, more: list) -> None:
    to[0] += more[0]
    to[1] = more[1] if to[1] is None else to[1] if more[1] is None else min(to[1], more[1])
    to[2:5] = [x + y for x, y in zip(to[2:5], more[2:5])]
    to[5] = to[5] or more[5]


def _common(a: bytes, b: bytes) -> int:
    k = 0
    while k < min(len(a), len(b)) and a[k : k + DIGEST] == b[k : k + DIGEST]:
        k += DIGEST
    return k // DIGEST


def _prefixes(path: bytes) -> list[bytes]:
    """The name of each of a path's nodes, the root's first."""
    state, out = hashlib.md5(), [hashlib.md5().digest()]
    for k in range(0, len(path), DIGEST):
        state.update(path[k : k + DIGEST])
        out.append(state.digest())
    return out


NODE = pa.struct([(c, pa.int64()) for c in ("depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")] + [("ends", pa.string()), ("above", pa.binary()), ("name", pa.binary())])
PATH = pa.struct([("path", pa.binary()), ("lengths", pa.list_(pa.int32())), ("hang", pa.list_(pa.struct([("depth", pa.int32()), *((c, pa.int64()) for c in ("n", "least", "children", "leaves", "saved")), ("ends", pa.string())])))])
ROW = (
    "chunk binary, node struct<depth:long, conv_id:long, parent_conv_id:long, n_convs:long, n_children:long, n_leaves:long, saved_tokens:long, ends:string, above:binary, name:binary>, "
    f"open struct<path:binary, lengths:array<int>, hang:{HANG}>"
)


def _grown(rows: DataFrame, whole: bool, named: bool) -> DataFrame:
    """(chunk, node, open): the closed nodes and the open sequences of each chunk of sorted sequences. With ``named`` nodes carry their names."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
        held, size = [], 0
        for x in slices(batches, "path", most=CHUNK):
            if size + x.column("path").nbytes > CHUNK and sum(h.num_rows for h in held) >= 8 and not whole:
                yield held
                held, size = [], 0
            held.append(x)
            size += x.column("path").nbytes
        if held:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in chunks(batches):
            t = pa.Table.from_batches(held)
            if not t.num_rows:
                continue
            paths = t.column("path").to_pylist()
            forest = _Forest(paths, t.column("lengths").to_pylist(), t.column("hang").to_pylist(), whole, named)
            opened = forest.grow()
            chunk = hashlib.md5(paths[0]).digest()
            keys = [f.name for f in NODE]
            for k in range(0, len(forest.nodes), 10_000):
                part = [dict(zip(keys, n)) for n in forest.nodes[k : k + 10_000]]
                yield _batch(chunk, part, [None] * len(part))
            yield _batch(chunk, [None] * len(opened), [{"path": paths[at], "lengths": forest.lengths[at], "hang": hang} for at, hang in opened])
        give_back()

    return rows.mapInArrow(run, ROW)


def _batch(chunk: bytes, nodes: list, opened: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([chunk] * len(nodes), pa.binary()), pa.array(nodes, NODE), pa.array(opened, PATH)], names=["chunk", "node", "open"])


def trie(df: DataFrame, key: str = "conv_id") -> DataFrame:
    """One row per node: conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    rows, levels, before = saved(classes(rebuilt(df, key), key), "sequences"), [], None
    while True:
        n = rows.count()
        whole = n <= LAST or (before is not None and 2 * n > before)
        dealt = rows.coalesce(1) if whole else rows.repartitionByRange("path")
        grown = saved(_grown(dealt.sortWithinPartitions("path"), whole, bool(levels)), "forest")
        levels.append(grown.where("node is not null").select("chunk", "node.*"))
        if whole:
            break
        rows, before = grown.where("open is not null").select("open.*"), n
    nodes = levels[0]
    if len(levels) > 1:
        # a node whose parent closed later finds it by name; each chunk asks once for each of the few nodes on its two paths
        late = levels[1]
        for level in levels[2:]:
            late = late.unionAll(level)
        asked = saved(levels[0].unionAll(late).where("above is not null").select("chunk", "above").distinct(), "asked")
        told = saved(asked.join(late.select(F.col("name").alias("above"), F.col("conv_id").alias("later")), "above"), "told")
        nodes = levels[0].unionAll(late).join(told, ["chunk", "above"], "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "later"))
    ends = F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256")
    return nodes.select(F.col("conv_id").alias(key), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", ends)
