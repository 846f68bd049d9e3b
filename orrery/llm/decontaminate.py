"""Benchmark decontamination: documents that hold an item within a fifth of its words in edits.

Texts are lower-cased sequences of letters-and-digits words. The CGK embedding reads a window by a random
walk: at each step it notes the word it stands on and moves on or stays, by a random bit of that step and
word. Windows at a small edit distance soon walk in step again, so their walks differ in few places. A table
samples a few places of a walk as a key; an item's window in a document meets the item in some table with high
probability. Windows are item sized: items are classed by length, the longest of a class a quarter longer than
the shortest, and every class has walks of its own, forward from a window's first word and backward from its
last, so that edits crowded into either half leave the other walk in step. Every class gets as many walks as it
takes for the target recall in a trial with random words and as many edits as are allowed, spread or crowded.
Exact word-level edit distance, with both ends of the window free, verifies every candidate.

Walks start only where they can succeed, which loses nothing: k edits leave at least n - g + 1 - g k of an item's
runs of g words whole, so a window without so many of its class's runs holds no item of the class.

An item of more than ``PIECE`` words is sought by its pieces: of pieces that make up an item with edits in a fifth of its words, one
at least has edits in no more than a fifth of its own. So planning takes no longer for longer items. Where ``WALKS`` don't reach the target recall, the job fails.

Items of fewer than ``SHORT`` words have too few steps to sample; of their edits + 1 pieces one is left whole, so
windows that hold a piece are the candidates, all of them. Items are held by tasks in blocks of at most ``ITEMS``
and of at most ``HELD`` words; a larger benchmark takes one pass a block.

Defined cases: null and empty texts hold nothing; items without words match nothing; repeated items and rows
are reported each; rows whose key is null are reported under null; an empty table on either side gives no matches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from orrery.llm.batches import give_back, slices

WORD = re.compile(r"\w+")
#: Shortest item that is sampled, share of edits, tables of a walk, places of a table, items and words of a block.
SHORT, EDITS, TABLES, PLACES, ITEMS, HELD = 8, 0.2, 6, 3, 50_000, 4_000_000
#: The longest piece of an item.
PIECE = 92
#: The recall of candidates that each class's walks are to reach in trials, and the most walks.
TARGET, WALKS = 0.97, 64
#: Words of a run, for telling where walks can succeed; bits of the map of runs.
GRAM, MAP = 3, 22
#: Bytes of text read at once, and words whose hashes a task keeps.
READ, KEPT = 2 << 20, 200_000


class _Hashes(dict):
    """The hash of each word, kept while there is room."""

    def __missing__(self, word: str) -> int:
        from xxhash import xxh64_intdigest

        h = xxh64_intdigest(word)
        if len(self) < KEPT:
            self[word] = h
        return h


def word_hashes(text: str | None, known: _Hashes | None = None):
    import numpy as np

    words = WORD.findall((text or "").lower())
    return np.fromiter(map((_Hashes() if known is None else known).__getitem__, words), np.uint64, len(words))


def allowed(n: int, edits: float = EDITS) -> int:
    return int(n * edits + 1e-9)


def _windows(h, n: int):
    """A hash of each run of n words."""
    import numpy as np

    out = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for k in range(n):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += h[k : k + len(out)]
    return out


def walk_keys(h, starts, walk: int, tables: list[list[int]]) -> list:
    """For each table the keys of the walks from ``starts`` along the words h."""
    import numpy as np

    last = max(max(t) for t in tables)
    cover = np.zeros(len(h) + last + 2, np.int32)  # only words that a walk may reach are looked at
    np.add.at(cover, starts, 1)
    np.add.at(cover, np.minimum(starts + last + 1, len(cover) - 1), -1)
    cover = np.cumsum(cover)[:-1] > 0
    place = np.cumsum(cover) - 1
    own = np.concatenate([h, np.zeros(last + 1, np.uint64)])[cover]
    at, bits, keys = place[starts], None, [np.zeros(len(starts), np.uint64) for _ in tables]
    sampled = {s: [k for k, t in enumerate(tables) if s in t] for t in tables for s in t}
    for s in range(last + 1):
        if s % 64 == 0:  # the random bits of the next 64 steps
            bits = (own ^ np.uint64(0x9E3779B97F4A7C15 * (2 * walk + 1) & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9 + 2 * (s // 64))
            bits ^= bits >> np.uint64(31)
            bits *= np.uint64(0x94D049BB133111EB)
            bits ^= bits >> np.uint64(29)
        if s in sampled:
            here = own.take(at)
            for k in sampled[s]:
                keys[k] *= np.uint64(0xD6E8FEB86659FD93)
                keys[k] += here
        if s < last:
            move = bits.take(at)
            move >>= np.uint64(s % 64)
            move &= np.uint64(1)
            at += move.view(np.int64)
    return keys


def _varied(rng, n: int, count: int, crowded: int, edits: float):
    """count random items of n words and a copy of each with as many edits as are allowed: spread, or in one half."""
    import numpy as np

    items, copies = [], []
    for _ in range(count):
        item = rng.integers(1, 1 << 63, n, dtype=np.uint64)
        copy, half = item.tolist(), n // 2
        for _ in range(allowed(n, edits)):
            lo, hi = ((0, len(copy)), (0, min(half, len(copy))), (min(half, len(copy) - 1), len(copy)))[crowded]
            k, how, word = int(rng.integers(lo, max(hi, lo + 1))), int(rng.integers(3)), int(rng.integers(1, 1 << 63))
            if how == 0:
                copy.insert(k, word)
            else:
                copy[k : k + 1] = [word] if how == 1 else []
        items.append(item)
        copies.append(np.array(copy, np.uint64))
    return items, copies


def _laid_out(parts, gap: int):
    """The parts one after another with random words between, and the places of each's first and last word."""
    import numpy as np

    rng, out, first, last, n = np.random.default_rng(1), [], [], [], 0
    for p in parts:
        out += [rng.integers(1, 1 << 63, gap, dtype=np.uint64), p]
        first.append(n + gap)
        n += gap + len(p)
        last.append(n - 1)
    return np.concatenate([*out, rng.integers(1, 1 << 63, gap, dtype=np.uint64)]), np.array(first), np.array(last)


@lru_cache(256)
def walks_of(low: int, high: int, edits: float, target: float, tables: int, places: int, seed: int = 6) -> tuple:
    """((walk, backward, tables), ...) for items of low to high words, as many as the target takes; and the recall they reach in trials."""
    import numpy as np

    rng, trials, sizes = np.random.default_rng((seed, low)), [], sorted({low, high})
    for n in sizes:
        for crowded in range(3):
            items, copies = _varied(rng, n, 300, crowded, edits)
            trials.append((_laid_out(items, 2 * high), _laid_out(copies, 2 * high)))
    met = [np.zeros(300, bool) for _ in trials]
    out, places = [], min(places, max(1, low // 4))
    for w in range(WALKS):
        backward = w % 2 == 1
        # every other pair of tables keeps to the first half of the walk
        own = [sorted(rng.choice(low if t % 3 == 2 else 2 * low, places, replace=False).tolist()) for t in range(tables)]
        out.append((w, backward, own))
        for m, pair in zip(met, trials):
            a, b = (walk_keys(h[::-1] if backward else h, len(h) - 1 - last if backward else first, w, own) for h, first, last in pair)
            for x, y in zip(a, b):
                m |= x == y
        reached = min(m.mean() for m in met)
        if reached >= target:
            return out, float(reached)
    raise ValueError(f"{WALKS} walks find {reached:.3f} of the items of {low} to {high} words with {edits} of them edited, under {target}")


def edits_within(item, words) -> int:
    """The least edit distance between the item and any run of the words."""
    import numpy as np

    before = np.zeros(len(words) + 1, np.int64)
    steps = np.arange(len(words) + 1)
    for k, w in enumerate(item):
        now = np.empty_like(before)
        now[0] = k + 1
        now[1:] = np.minimum(before[:-1] + (words != w), before[1:] + 1)
        before = np.minimum.accumulate(now - steps) + steps  # gaps along the row
    return int(before.min())


class _Table:
    """Keys and what has them, sorted, behind a bit map of the keys' upper bits."""

    def __init__(self, keys, owners):
        import numpy as np

        order = np.argsort(keys, kind="stable")
        self.keys, self.owners = keys[order], owners[order]
        self.there = np.zeros(1 << 16, bool)
        self.there[(self.keys >> np.uint64(48)).astype(np.int64)] = True

    def probe(self, keys):
        """(places in keys, owners) of all that are equal."""
        import numpy as np

        at = np.flatnonzero(self.there.take((keys >> np.uint64(48)).view(np.int64)))
        lo, hi = np.searchsorted(self.keys, keys[at], "left"), np.searchsorted(self.keys, keys[at], "right")
        n = hi - lo
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(at, n), self.owners[np.repeat(lo, n) + within]


class _Class:
    """The items of about one length: their runs, walks and tables."""

    def __init__(self, low: int, high: int, members: list[tuple[int, object]], edits: float, target: float, tables: int, places: int):
        import numpy as np

        sizes = {len(h) for _, h in members}
        self.longest = max(sizes)
        self.most = allowed(self.longest, edits)
        self.gram = max(1, min([GRAM] + [-(-(n - allowed(n, edits)) // (allowed(n, edits) + 1)) for n in sizes]))
        self.least = max(1, min(n - self.gram + 1 - self.gram * allowed(n, edits) for n in sizes))
        self.runs = np.zeros(1 << MAP, bool)
        for _, h in members:
            self.runs[self._spot(_windows(h, self.gram))] = True
        self.walks, self.reached = walks_of(low, high, edits, target, tables, places)
        flat, first, last = _laid_out([h for _, h in members], 1)
        owners = np.array([k for k, _ in members])
        gap = np.zeros(len(flat), bool)  # between items nothing stands, as beyond a text's end
        gap[np.concatenate([first - 1, [len(flat) - 1]])] = True
        flat = np.where(gap, np.uint64(0), flat)
        self.tables = []
        for w, backward, own in self.walks:
            keys = walk_keys(flat[::-1] if backward else flat, len(flat) - 1 - last if backward else first, w, own)
            self.tables.append([_Table(k, owners) for k in keys])

    @staticmethod
    def _spot(grams):
        import numpy as np

        return ((grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - MAP)).astype(np.int64)

    def candidates(self, flat, sizes) -> Iterator[tuple]:
        """(items, places where they may start)."""
        import numpy as np

        spots = self.runs.take(self._spot(_windows(flat, self.gram)))
        if int(spots.sum()) < self.least:
            return
        span = self.longest + self.most - self.gram + 1
        total = np.concatenate([np.zeros(span, np.int32), np.cumsum(np.concatenate([[0], spots]), dtype=np.int32)])
        total = np.concatenate([total, np.full(span + self.gram, total[-1], np.int32)])  # total[span + k]: runs that start before word k
        at = np.arange(len(flat))
        forward = np.flatnonzero(total[2 * span + at] - total[span + at] >= self.least)
        end = at - self.gram + 2  # runs that end at this word or before it start before that word
        ends = np.flatnonzero(total[np.maximum(span + end, span)] - total[np.maximum(end, 0)] >= self.least)
        for (w, backward, own), tables in zip(self.walks, self.tables):
            some = ends if backward else forward
            if len(some):
                for table, keys in zip(tables, walk_keys(flat[::-1] if backward else flat, len(flat) - 1 - some if backward else some, w, own)):
                    place, items = table.probe(keys)
                    if len(items):
                        yield items, some[place] - sizes[items] + 1 if backward else some[place]


class Block:
    """Items with their keys, for tasks."""

    def __init__(self, items: list[tuple[object, object]], edits: float = EDITS, target: float = TARGET, tables: int = TABLES, places: int = PLACES):
        import numpy as np

        self.items, self.edits = items, edits
        self.sizes = np.array([len(h) for _, h in items], np.int64)
        #: (item, the piece's place in it, its words) of items that are walked
        pieces = [(k, n * j // m, h[n * j // m : n * (j + 1) // m]) for k, (_, h) in enumerate(items) if (n := len(h)) >= SHORT for m in [-(-n // PIECE)] for j in range(m)]
        self.owners, self.offsets, self.lengths = (np.array([f(p) for p in pieces], np.int64) for f in (lambda p: p[0], lambda p: p[1], lambda p: len(p[2])))
        self.classes, low = [], SHORT
        while pieces and low <= self.lengths.max():
            high = max(low, low * 5 // 4)
            members = [(k, h) for k, (_, _, h) in enumerate(pieces) if low <= len(h) <= high]
            if members:
                self.classes.append(_Class(low, high, members, edits, target, tables, places))
            low = high + 1
        short: dict[int, list] = {}  # pieces by length: (hash, item, the piece's place in it)
        for k, (_, h) in enumerate(items):
            if 0 < len(h) < SHORT:
                n = allowed(len(h), edits) + 1
                cuts = [len(h) * j // n for j in range(n + 1)]
                for a, b in zip(cuts, cuts[1:]):
                    short.setdefault(b - a, []).append((int(_windows(h[a:b], b - a)[0]), k, a))
        self.short = {n: (_Table(np.array([r[0] for r in rows], np.uint64), np.arange(len(rows))), np.array([r[1] for r in rows]), np.array([r[2] for r in rows])) for n, rows in short.items()}

    def _candidates(self, flat) -> Iterator[tuple]:
        for n, (table, items, offsets) in self.short.items():
            place, rows = table.probe(_windows(flat, n))
            yield items[rows], place - offsets[rows]
        for c in self.classes:
            for pieces, place in c.candidates(flat, self.lengths):
                yield self.owners[pieces], place - self.offsets[pieces]

    def matches(self, texts: list[str | None], known: _Hashes | None = None) -> list[list[tuple[object, int, int]]]:
        """For each text the items it holds: (item, edits, the word near which it starts)."""
        import numpy as np

        known = _Hashes() if known is None else known
        own = [word_hashes(t, known) for t in texts]
        starts = np.cumsum([0, *map(len, own)])
        flat = np.concatenate(own) if own else np.zeros(0, np.uint64)
        out: list[list] = [[] for _ in texts]
        found = [x for x in self._candidates(flat) if len(x[0])] if len(flat) and self.items else []
        if not found:
            return out
        items, places = (np.concatenate([x[k] for x in found]) for k in (0, 1))
        most = (self.sizes[items] * self.edits + 1e-9).astype(np.int64)
        low, high = np.clip(places - most, 0, len(flat) - 1), np.clip(places + self.sizes[items] + most - 1, 0, len(flat) - 1)
        low, high = np.searchsorted(starts, low, side="right") - 1, np.searchsorted(starts, high, side="right") - 1
        n = high - low + 1  # a window may start before its document where its first words are lost
        docs = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - low, n)
        now, best, seen = None, None, 0
        for d, k, a in [*np.unique(np.stack([docs, np.repeat(items, n), np.repeat(places, n)], axis=1), axis=0).tolist(), (-1, -1, 0)]:
            if now != (d, k):
                if best:
                    out[now[0]].append((self.items[now[1]][0], *best))
                now, best, seen = (d, k), None, -(1 << 60)
            if d < 0 or a <= seen:
                continue
            name, h = self.items[k]
            n, most = len(h), allowed(len(h), self.edits)
            lo, hi = max(int(starts[d]), a - most), min(int(starts[d + 1]), a + n + (2 if n <= PIECE else 3) * most)
            if hi - lo < n - most or np.isin(h, flat[lo:hi]).sum() < n - most:
                continue
            seen = a + most // 2  # starts this near lie in the window that is read here
            same = a >= lo and a + n <= hi and np.array_equal(flat[a : a + n], h)
            edits = 0 if same else edits_within(h, flat[lo:hi])
            if edits <= most and (best is None or edits < best[0]):
                best = (edits, max(0, a - int(starts[d])))
        return out


def blocks(items: DataFrame, key: str = "item_id", text: str = "text", size: int = ITEMS, held: int = HELD, **planned) -> Iterator[Block]:
    """The benchmark in blocks of bounded size; an item of more than ``held`` words is a block of its own."""
    now: list = []
    words = 0
    for r in items.select(key, text).orderBy(key, text).toLocalIterator():
        h = word_hashes(r[text])
        if now and (len(now) == size or words + len(h) > held):
            yield Block(now, **planned)
            now, words = [], 0
        now.append((r[key], h))
        words += len(h)
    if now:
        yield Block(now, **planned)


def matches(df: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", **planned) -> DataFrame:
    """(key, item, edits, start): a row for each document and item that it holds."""
    kinds = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField(item, items.schema[item].dataType), T.StructField("edits", T.IntegerType()), T.StructField("start", T.IntegerType())])
    out = df.sparkSession.createDataFrame([], kinds)
    for block in blocks(items, item, item_text, **planned):
        shared = df.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known = _Hashes()
            for x in slices(batches, text, most=READ):
                found = [(k, *m) for k, ms in zip(x.column(key).to_pylist(), shared.value.matches(x.column(text).to_pylist(), known)) for m in ms]
                if found:
                    yield pa.RecordBatch.from_pylist([dict(zip(kinds.names, f)) for f in found], schema=_arrow(kinds))
            known.clear()
            give_back()

        out = out.unionAll(df.select(key, text).mapInArrow(run, kinds))
    return out


def _arrow(kinds: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(kinds)


def clean(df: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", **planned) -> DataFrame:
    """The rows of df whose text holds no item."""
    for block in blocks(items, item, item_text, **planned):
        shared = df.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known = _Hashes()
            for x in slices(batches, text, most=READ):
                yield x.filter(pa.array([not m for m in shared.value.matches(x.column(text).to_pylist(), known)], pa.bool_()))
            known.clear()
            give_back()

        df = df.mapInArrow(run, df.schema)
    return df
