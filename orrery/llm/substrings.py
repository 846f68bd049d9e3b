"""Substring dedup with a count-min prefilter.

A window is a run of consecutive words of one document. A word goes if a window that covers it also starts
in a document with a smaller id; windows are judged on the input, not on what is left.

First pass: each task adds the windows of its documents (a document counts once for each window) to partial
count-min sketches; partial sketches are merged by cell ranges. A cell's count is at least that of any window
in it, so windows whose cells don't all reach two start in one document only. Second pass: the others are
grouped exactly, by a 96-bit key of their words. The filter loses no repeated window whatever its size: if
a corpus overfills the sketch, more windows are grouped, and the result is the same.

The sketch has two to four cells for each window, as the corpus' bytes tell, and no more than ``2**CELLS``: the merged
sketch is broadcast as compressed bits (cell reaches two), ``ROWS * 2**CELLS / 8`` bytes at most whatever the corpus.
Beyond that it lets more windows through, all of them in the end, and the exact grouping does the work. A window that many
documents share is reduced to one row a task before it is shuffled for its smallest document, and the join that
returns this to the windows is one that Spark splits where a key is hot.

Defined cases: null and empty texts have no words and keep the empty string; texts shorter than a window
keep everything; repeats within one document stay; rows whose id is null take no part and keep everything;
rows that share an id are told apart by their text, and lose only what starts in a document with a smaller id; an empty
table gives an empty one.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from orrery.llm.batches import give_back, slices
from orrery.llm.shared import saved

WINDOW = 13
#: The sketch has ROWS rows of 2**CELLS cells at most, kept in shards of 2**SHARD cells; a partial sketch is sent on after FLUSH windows.
ROWS, CELLS, SHARD, FLUSH = 2, 29, 20, 2_000_000
#: Bytes of text whose words a task holds at once; a longer text is held alone.
READ = 1 << 20


def cells_for(df: DataFrame, text: str, most: int = CELLS) -> int:
    """The sketch's size for a corpus: two to four cells for each word, at five bytes and a space each."""
    total = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return min(most, max(16, int(total // 6).bit_length() + 1))


def window_keys(words: list[bytes], size: int):
    """Two arrays, 64 and 32 bits, that together stand for the words of each window."""
    import numpy as np
    from xxhash import xxh64_intdigest

    n = len(words) - size + 1
    if n < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32)
    h = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    a, b = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    g = h ^ (h >> np.uint64(31))
    for k in range(size):
        a = a * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
        b = b * np.uint64(0xD6E8FEB86659FD93) + g[k : k + n]
    a ^= a >> np.uint64(32)
    a *= np.uint64(0xBF58476D1CE4E5B9)
    a ^= a >> np.uint64(29)
    return a, (b >> np.uint64(32)).astype(np.uint32).view(np.int32)


def cell(keys, row: int, cells: int):
    import numpy as np

    return ((keys * np.uint64((0x94D049BB133111EB, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD, 0x2545F4914F6CDD1D)[row])) >> np.uint64(64 - cells)).astype(np.int64)


def sketch(df: DataFrame, text: str, size: int = WINDOW, rows: int = ROWS, cells: int = CELLS, shard: int = SHARD) -> DataFrame:
    """(row, shard, bits): for each shard of the merged sketch a bit for each cell, set if its count is two or more; compressed."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        held: list = []

        def sent() -> pa.RecordBatch:
            keys, out = np.concatenate(held), []
            for r in range(rows):
                at = np.sort(cell(keys, r, cells))
                if len(at) > 2:  # a count above two tells no more than two
                    at = at[np.concatenate(([True, True], at[2:] != at[:-2]))]
                for s, part in zip(np.unique(at >> shard), np.split(at, np.flatnonzero(np.diff(at >> shard)) + 1)):
                    blocks = np.bincount((part & ((1 << shard) - 1)) >> 16, minlength=1 << max(0, shard - 16)).astype("<u4")
                    out.append((r, int(s), blocks.tobytes(), (part & 0xFFFF).astype("<u2").tobytes()))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["row", "shard", "blocks", "low"])

        for x in slices(batches, text, most=READ):
            for t in x.column(text).to_pylist():
                keys = np.unique(window_keys((t or "").encode().split(), size)[0])
                if len(keys):
                    held.append(keys)
            if sum(map(len, held)) >= FLUSH:
                yield sent()
        if held:
            yield sent()
        give_back()

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        now, counts, held, waiting = None, None, [], 0

        def added() -> None:
            nonlocal counts, held, waiting
            if held:
                counts = np.minimum(counts + np.bincount(np.concatenate(held), minlength=1 << shard), 2).astype(np.uint8)
            held, waiting = [], 0

        def done() -> pa.RecordBatch:
            added()
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), pa.array([zlib.compress(np.packbits(counts > 1, bitorder="little"), 1)], pa.binary())], names=["row", "shard", "bits"])

        for x in slices(batches, "low"):
            for row, s, blocks, low in zip(*(c.to_pylist() for c in x.columns)):
                if (row, s) != now:
                    if now is not None:
                        yield done()
                    now, counts = (row, s), np.zeros(1 << shard, np.uint8)
                held.append(np.repeat(np.arange(len(blocks) // 4) << 16, np.frombuffer(blocks, "<u4")) + np.frombuffer(low, "<u2"))
                waiting += len(held[-1])
                if waiting >= 1 << shard:
                    added()
        if now is not None:
            yield done()
        counts = None
        give_back()

    parts = df.select(text).mapInArrow(partial, "row int, shard int, blocks binary, low binary")
    return parts.repartition("row", "shard").sortWithinPartitions("row", "shard").mapInArrow(merged, "row int, shard int, bits binary")


_HELD: dict = {}


def _merged(name: str, shared, rows: int, cells: int, shard: int):
    """The sketch's bits in a worker, which holds one sketch at a time."""
    import numpy as np

    if name not in _HELD:
        _HELD.clear()
        bits = np.zeros((rows, 1 << (cells - 3)), np.uint8)
        for row, s, packed in shared.value:
            bits[row, s << (shard - 3) : (s + 1) << (shard - 3)] = np.frombuffer(zlib.decompress(packed), np.uint8)
        _HELD[name] = bits
    return _HELD[name]


def merged_sketch(df: DataFrame, text: str, size: int = WINDOW, rows: int = ROWS, cells: int | None = None, shard: int = SHARD) -> tuple:
    """The sketch of a corpus for its windows, as tasks take it: its name, its broadcast shards, and its measures."""
    cells = cells or cells_for(df, text)
    shard = min(shard, cells)
    shards = [tuple(r) for r in sketch(df, text, size, rows, cells, shard).toLocalIterator()]
    return uuid.uuid4().hex, df.sparkSession.sparkContext.broadcast(shards), rows, cells, shard


def repeated(df: DataFrame, text: str, key: str, merged: tuple, size: int = WINDOW, row: bool = False) -> DataFrame:
    """(h, g, key, at): the windows whose estimated count is two or more; with ``row`` also the row's text as Spark's xxhash64 gives it."""
    name, shared, rows, cells, shard = merged

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = _merged(name, shared, rows, cells, shard)
        import numpy as np

        from xxhash import xxh64_intdigest

        for x in slices(batches, text, most=READ):
            ids, found = x.column(key).to_numpy(zero_copy_only=False), []
            for i, t in zip(ids, x.column(text).to_pylist()):
                t = (t or "").encode()
                h, g = window_keys(t.split(), size)
                keep = np.ones(len(h), bool)
                for r in range(rows):
                    c = cell(h, r, cells)
                    keep &= (bits[r][c >> 3] >> (c & 7).astype(np.uint8) & 1).astype(bool)
                at = np.flatnonzero(keep)
                if len(at):
                    own = (np.full(len(at), xxh64_intdigest(t, 42), np.uint64).view(np.int64),) if row else ()
                    found.append((h[at].view(np.int64), g[at], np.full(len(at), i, np.int64), at.astype(np.int32), *own))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[k] for f in found])) for k in range(4 + row)], names=["h", "g", key, "at", "row"][: 4 + row])
        give_back()

    return df.select(key, text).mapInArrow(run, f"h long, g int, `{key}` long, at int" + ", row long" * row)


def removed_places(df: DataFrame, text: str = "text", key: str = "doc_id", size: int = WINDOW, **sketched) -> DataFrame:
    """(key, row, places): the starts of each row's windows that also start in a document with a smaller id; ``row`` is a hash of its text."""
    docs = df.select(F.col(key).cast("long").alias(key), text).where(F.col(key).isNotNull())
    merged = merged_sketch(docs, text, size, **sketched)
    windows = repeated(docs, text, key, merged, size)
    first = windows.groupBy("h", "g").agg(F.min(key).alias("first"), F.max(key).alias("last")).where("first < last").select("h", "g", "first")
    first = saved(first, "windows")
    later = repeated(docs, text, key, merged, size, row=True).join(first, ["h", "g"]).where(F.col(key) > F.col("first"))
    return saved(later.groupBy(key, "row").agg(F.collect_list("at").alias("places")), "places")


def dedup(df: DataFrame, text: str = "text", key: str = "doc_id", size: int = WINDOW, out: str = "kept", **sketched) -> DataFrame:
    """df with ``out`` (the words kept, joined by one space), ``n_words`` and ``n_removed``; the text column goes."""
    left = [f for f in df.schema if f.name not in (text, out, "n_words", "n_removed")]
    own = "places that go"  # names that a caller's columns won't have
    places = removed_places(df, text, key, size, **sketched).toDF("places key", "places row", own)
    same = (F.col(key) == F.col("places key")) & (F.xxhash64(text) == F.col("places row"))
    joined = df.select(*(f.name for f in left), text).join(places, same, "left").drop("places key", "places row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        _HELD.clear()  # a worker that served the passes before needs its sketch no more
        for x in slices(batches, text, most=READ):
            kept, n_words, n_removed = [], [], []
            for t, at in zip(x.column(text).to_pylist(), x.column(own)):
                words = (t or "").encode().split()
                n_words.append(len(words))
                if at.is_valid and words:
                    edge = np.zeros(len(words) + size + 1, np.int64)
                    at = at.values.to_numpy()
                    at = at[at < len(words)]
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + size, -1)
                    stays = np.cumsum(edge)[: len(words)] == 0
                    words = [w for w, s in zip(words, stays.tolist()) if s]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words).decode())
            arrays = [pa.array(kept, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())]
            yield pa.RecordBatch.from_arrays([*(x.column(f.name) for f in left), *arrays], names=[*(f.name for f in left), out, "n_words", "n_removed"])
        give_back()

    return joined.mapInArrow(run, T.StructType([*left, T.StructField(out, T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())]))
