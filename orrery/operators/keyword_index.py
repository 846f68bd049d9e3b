"""A keyword index: posting lists of character trigrams, intersected, then verified against the texts.

A document that holds a term holds each of the term's trigrams; shorter terms are looked up whole, for which one- and
two-character grams have lists too. Grams are hashed to 32 bits: a collision adds candidates, which verification drops again, and loses none.
Documents are dealt to blocks of about ``BLOCK`` by the hash of their id. A posting list is one of a block, as places in it or as a bit for each
place, whichever is shorter; so a task indexes a block by itself, and no gram of a document is shuffled. A term is sought by its ``RAREST``
rarest grams. A search brings the lists of these and the texts of a block together, where terms are verified and counted.

``top`` is for batches of queries that grow with the corpus, of which no list of all matches can be kept: documents and queries meet
in blocks, and of a block only the best documents of each query go on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from orrery.operators.lineage import cut, ship
from orrery.operators.retrieval import keyword_matches, ranked

#: Documents (below 65,536) and characters of a block, grams that a term is sought by, folders of posting lists.
BLOCK, LETTERS, RAREST, FOLDERS = 4096, 1 << 24, 4, 16
#: Characters whose grams are made at once, queries that are counted together and those whose counts go into one batch.
GRAMMED, PIECE, TOLD = 1 << 20, 2048, 64
#: Queries and documents that meet in one task, documents and characters that it searches at once, and queries counted at once.
QUERIES, DOCUMENTS, AT_ONCE, CHARACTERS, COUNTED = 262_144, 65_536, 1024, 1 << 22, 256
#: Documents that are counted over at once, bytes of a table of terms by documents, words that a task remembers, and a byte that is in no text.
SPAN, CELLS, WORDS, GAP = 8192, 1 << 26, 1 << 19, b"\xff"


@dataclass(frozen=True)
class Index:
    """postings: (folder, gram, block, n, dense, bits), of n places each. grams: (gram, n), how many documents hold each. blocks: (block, blocks, ids), the ids by place."""

    postings: DataFrame
    grams: DataFrame
    blocks: DataFrame


def _codes(texts: list[str]):
    """The letters of the texts as numbers, and the number of each letter's text."""
    import numpy as np

    codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
    return np.concatenate(codes), np.repeat(np.arange(len(codes)), [len(c) for c in codes])


def _grams(texts: list[str], lengths: tuple[int, ...]):
    """The distinct hashed grams, of the lengths given, of each text after the other, and how many each text has."""
    import numpy as np

    letters, of = _codes(texts)
    sizes = np.bincount(of, minlength=len(texts))
    keys, rolled = np.zeros(len(letters), np.uint64), []
    for n in range(1, max(lengths) + 1):
        keys = _rolled(keys[: max(0, len(letters) - n + 1)], letters[n - 1 :])
        if n in lengths:
            rolled.append((n, ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)))
    out = []
    for end, size in zip(np.cumsum(sizes).tolist(), sizes.tolist()):  # a text's grams are sorted faster than those of many
        own = np.concatenate([np.zeros(0, np.uint32), *(r[end - size : end - n + 1] for n, r in rolled if size >= n)])
        own.sort()
        out.append(own[np.diff(own, prepend=~own[:1]) != 0])
    return np.concatenate(out), np.array([len(x) for x in out])


def _signed(grams):
    import numpy as np

    return np.ascontiguousarray(grams, np.uint32).view(np.int32)


def _block(key: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def build(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> Index:
    """Writes the index of the texts below path. Rows without an id or text are in no list."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(key).alias("doc_id"), F.lower(text).alias("low")).where("doc_id is not null and low <> ''")
    n, letters = rows.agg(F.count("*"), F.coalesce(F.sum(F.length("low")), F.lit(0))).first()
    blocks = max(1, -(-n // BLOCK), -(-letters // LETTERS))
    kind = rows.schema["doc_id"].dataType.simpleString()
    dealt = rows.select(_block("doc_id", blocks).alias("block"), "doc_id", "low")
    dealt.select("block", "doc_id").groupBy("block").agg(F.array_sort(F.collect_set("doc_id")).alias("ids")).withColumn("blocks", F.lit(blocks)).write.mode("overwrite").parquet(f"{path}/blocks")
    met = dealt.repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "doc_id")
    met.mapInArrow(_listed, "gram int, block int, n int, dense boolean, bits binary").withColumn("folder", F.pmod("gram", F.lit(FOLDERS))).write.mode("overwrite").partitionBy("folder").parquet(f"{path}/postings")
    _postings(spark, path).groupBy("gram").agg(F.sum("n").alias("n")).write.mode("overwrite").parquet(f"{path}/grams")
    return read(spark, path, kind)


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The posting lists of blocks of documents, which come by block and id."""
    import numpy as np

    at, last, place, shared, found, texts, places, letters = None, None, -1, False, [], [], [], 0

    def gram() -> None:
        nonlocal texts, places, letters
        if texts:
            grams, n = _grams(texts, (1, 2, 3))
            found.append((grams.astype(np.uint64) << np.uint64(16)) + np.repeat(np.array(places, np.uint64), n))
        texts, places, letters = [], [], 0

    def told() -> Iterator[pa.RecordBatch]:
        gram()
        if not found:
            return
        pairs = np.concatenate(found)
        pairs.sort()
        if shared:
            pairs = np.unique(pairs)
        grams, own = (pairs >> np.uint64(16)).astype(np.uint32), (pairs & np.uint64(0xFFFF)).astype(np.uint16)
        first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
        known, n = grams[first], np.diff(first, append=len(grams))
        width = -(-(place + 1) // 8)
        dense = 2 * n > width
        kept = np.repeat(~dense, n)
        ends = np.concatenate([[0], np.cumsum(2 * n[~dense])]).astype(np.int32)
        yield batch_of(known[~dense], n[~dense], False, pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(own[kept])]))
        for a in range(0, len(some := np.flatnonzero(dense)), 1024):
            g = some[a : a + 1024]
            bits = np.zeros((len(g), width * 8), bool)
            row = np.repeat(np.arange(len(g)), n[g])
            bits[row, own[np.repeat(first[g] - np.cumsum(n[g]) + n[g], n[g]) + np.arange(len(row))]] = True
            yield batch_of(known[g], n[g], True, pa.array([x.tobytes() for x in np.packbits(bits, axis=1)], pa.binary()))

    def batch_of(grams, n, dense, bits) -> pa.RecordBatch:
        columns = [pa.array(_signed(grams)), pa.array(np.full(len(n), at, np.int32)), pa.array(n.astype(np.int32)), pa.array(np.full(len(n), dense)), bits]
        return pa.RecordBatch.from_arrays(columns, names=["gram", "block", "n", "dense", "bits"])

    for x in batches:
        for r in (r for j in range(0, x.num_rows, 256) for r in x.slice(j, 256).to_pylist()):
            if r["block"] != at:
                yield from told()
                at, last, place, shared, found = r["block"], None, -1, False, []
            if r["doc_id"] != last:  # rows that share an id share a place
                last, place = r["doc_id"], place + 1
            else:
                shared = True
            texts.append(r["low"])
            places.append(place)
            letters += len(r["low"])
            if letters >= GRAMMED:
                gram()
    yield from told()


def _postings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("gram int, block int, n int, dense boolean, bits binary, folder int").parquet(f"{path}/postings")


def read(spark: SparkSession, path: str, kind: str = "long") -> Index:
    """The index below path, of documents whose ids are of the kind given."""
    return Index(_postings(spark, path), spark.read.schema("gram int, n long").parquet(f"{path}/grams"), spark.read.schema(f"block int, blocks int, ids array<{kind}>").parquet(f"{path}/blocks"))


def _term_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, gram): a term's trigrams, or a shorter term's own gram."""
    import numpy as np

    for x in batches:
        terms = x.column("term").to_pylist()
        for n in {min(len(t), 3) for t in terms}:
            own = [t for t in terms if min(len(t), 3) == n]
            grams, each = _grams(own, (n,))
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()).take(pa.array(np.repeat(np.arange(len(own)), each))), pa.array(_signed(grams))], names=["term", "gram"])


def sought(terms: DataFrame, index: Index) -> DataFrame:
    """(folder, gram, term, need): the rarest grams of each distinct term, which is in lower case, and how many they are."""
    grams = terms.select("term").mapInArrow(_term_grams, "term string, gram int")
    known = grams.join(index.grams, "gram", "left").groupBy("term").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))).alias("grams"))
    known = known.where(F.col("grams")[0]["n"] > 0)  # a gram that no document holds rules its term out
    rare = known.select("term", F.slice("grams", 1, RAREST).alias("grams"))
    return rare.select("term", F.size("grams").alias("need"), F.explode("grams.gram").alias("gram")).withColumn("folder", F.pmod("gram", F.lit(FOLDERS)))


def matches(docs: DataFrame, terms: DataFrame, index: Index) -> DataFrame:
    """(query_id, doc_id, match_count, len): how many terms (query_id, term) each document holds, whatever their case.

    A block's texts meet the terms whose grams it has lists of, each with its queries, some ``PIECE`` of them at a time.
    A text is read and lowered once, for all of its terms.
    """
    spark = docs.sparkSession
    ship(spark)
    wanted = terms.select("query_id", F.lower("term").alias("term")).where("term <> '' and query_id is not null").distinct()
    kind, asking = index.blocks.schema["ids"].dataType.elementType.simpleString(), wanted.schema["query_id"].dataType.simpleString()
    own = docs.schema["doc_id"].dataType.simpleString()
    first = index.blocks.select("blocks").first()
    blocks = first["blocks"] if first else 1
    # written, so that their size is known and the lists need no shuffle to be joined with few of them
    rare = cut(sought(wanted.select("term").distinct(), index))
    lists = index.postings.join(rare, ["folder", "gram"]).groupBy("block", "term", "need").agg(F.collect_list(F.struct("dense", "bits")).alias("lists")).where(F.size("lists") == F.col("need"))
    pieces = max(1, -(-wanted.select("query_id").distinct().count() // PIECE))
    asked = cut(wanted.groupBy("term", F.pmod(F.xxhash64("query_id"), F.lit(pieces)).cast("int").alias("piece")).agg(F.collect_list("query_id").alias("queries")))
    columns = {"kind": "int", "piece": "int", "id": kind, "len": "int", "text": "string", "ids": f"array<{kind}>", "lists": "array<struct<dense:boolean,bits:binary>>", "queries": f"array<{asking}>"}
    row = lambda df, **known: df.select("block", *(known.get(c, F.lit(None)).cast(t).alias(c) for c, t in columns.items()))
    texts = docs.where("doc_id is not null and text <> ''").select(F.col("doc_id").cast(kind).alias("id"), F.length("text").alias("len"), F.lower("text").alias("text"))
    met = row(index.blocks, kind=F.lit(0), ids=F.col("ids"))
    met = met.unionAll(row(texts.withColumn("block", _block("id", blocks)), kind=F.lit(1), id=F.col("id"), len=F.col("len"), text=F.col("text")))
    met = met.unionAll(row(lists.join(asked, "term"), kind=F.lit(2), piece=F.col("piece"), text=F.col("term"), lists=F.col("lists"), queries=F.col("queries")))
    met = met.repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "kind", "piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block, piece = None, None, None
        for x in batches:
            types = x.schema.field("id").type, x.schema.field("queries").type.value_type
            for r in (r for j in range(0, x.num_rows, 256) for r in x.slice(j, 256).to_pylist()):
                if (r["block"], r["piece"]) != (at, piece):
                    if block:
                        yield from block.told()
                    if r["block"] != at:
                        block = _Texts(*types)
                    at, piece = r["block"], r["piece"]
                block.add(r)
        if block:
            yield from block.told()

    found = met.mapInArrow(run, f"query_id {asking}, doc_id {kind}, match_count long, len int")
    return found.withColumn("doc_id", F.col("doc_id").cast(own))


class _Texts:
    """A block: the ids of its places, its texts, then the terms that its lists may hold, by pieces of the queries that ask for them."""

    def __init__(self, id_type: pa.DataType, query_type: pa.DataType) -> None:
        self.types, self.place, self.rows, self.texts, self.verified, self.counts = (id_type, query_type), {}, [], None, {}, None

    def add(self, r: dict) -> None:
        if r["kind"] == 0:
            self.place = {d: i for i, d in enumerate(r["ids"])}
        elif r["kind"] == 1:
            if (p := self.place.get(r["id"])) is not None:
                self.rows.append((p, r["id"], r["len"], r["text"]))
        elif self.rows:
            self._count(r)

    def _start(self) -> None:
        import numpy as np

        self.rows.sort(key=lambda x: x[0])
        self.at = np.array([x[0] for x in self.rows])
        self.first = np.flatnonzero(np.diff(self.at, prepend=-1))  # the first row of each id
        self.lens = np.array([x[2] for x in self.rows], np.int32)
        self.ids = pa.array([self.rows[i][1] for i in self.first], self.types[0])
        self.texts = [x[3] for x in self.rows]

    def _held(self, term: str, lists: list[dict]):
        """Which rows hold the term."""
        import numpy as np

        may = np.ones(-(-len(self.place) // 8) * 8, bool)
        for x in lists:
            if x["dense"]:
                may &= np.unpackbits(np.frombuffer(x["bits"], np.uint8)).view(bool)
            else:
                only = np.zeros(len(may), bool)
                only[np.frombuffer(x["bits"], np.uint16)] = True
                may &= only
        some = np.flatnonzero(may[self.at])
        texts = self.texts
        held = np.zeros(len(texts), bool)
        held[[i for i in some.tolist() if term in texts[i]]] = True
        return held

    def _count(self, r: dict) -> None:
        import numpy as np

        if self.counts is None:
            if self.texts is None:
                self._start()
            self.number, self.counts = {}, []
        held = self.verified.get(r["text"])
        if held is None:
            held = self.verified[r["text"]] = np.packbits(self._held(r["text"], r["lists"]))
        for q in r["queries"]:
            self.counts.append((self.number.setdefault(q, len(self.number)), held))

    def told(self) -> Iterator[pa.RecordBatch]:
        """The counts of the piece's queries."""
        import numpy as np

        if not self.counts:
            return
        queries, n = pa.array(list(self.number), self.types[1]), len(self.texts)
        terms = [[] for _ in self.number]
        for q, held in self.counts:
            terms[q].append(held)
        self.counts = None
        for a in range(0, len(terms), TOLD):
            count = np.stack([np.unpackbits(np.stack(own), axis=1, count=n).sum(0, dtype=np.int64) for own in terms[a : a + TOLD]])
            lens = np.broadcast_to(self.lens, count.shape)
            if len(self.first) < n:  # of rows that share an id, the terms of all and the least length of those that hold any
                lens = np.minimum.reduceat(np.where(count > 0, lens, np.iinfo(np.int32).max), self.first, axis=1)
                count = np.add.reduceat(count, self.first, axis=1)
            q, d = np.nonzero(count)
            yield pa.RecordBatch.from_arrays([queries.take(pa.array(a + q)), self.ids.take(pa.array(d)), pa.array(count[q, d]), pa.array(lens[q, d])], names=["query_id", "doc_id", "match_count", "len"])


def top(docs: DataFrame, terms: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, match_count, len, rank): of each query (query_id, term) the k documents (doc_id, text) that hold most of its terms, whatever their case; of equal ones the shorter, then that of the smaller id.

    Queries and documents meet in blocks, each of which a task holds: every block of queries is dealt to every bucket of
    documents. A task keeps k documents a query. Ids are whole numbers; rows that share one count together, and are searched apart.
    """
    ship(docs.sparkSession)
    wanted = terms.select(F.col("query_id").cast("long").alias("query_id"), F.lower("term").alias("term")).where("query_id is not null and term <> ''").distinct()
    rows = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    ids = rows.groupBy("doc_id").agg(F.count("*").alias("n"))
    repeated = ids.where("n > 1").select("doc_id")
    n_docs, shared = ids.agg(F.count("*"), F.count_if(F.col("n") > 1)).first()
    asked = wanted.groupBy("query_id").agg(F.collect_list("term").alias("terms"))
    n_queries = asked.count()
    chunks, buckets = max(1, -(-n_queries // QUERIES)), max(1, -(-n_docs // DOCUMENTS), min(48, n_docs // AT_ONCE))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    once = rows.join(repeated, "doc_id", "left_anti") if shared else rows
    left = asked.select(dealt("query_id", chunks).alias("chunk"), every(buckets).alias("bucket"), F.col("query_id").alias("id"), F.lit(None).cast("int").alias("len"), F.lit(None).cast("string").alias("low"), "terms")
    right = once.select(every(chunks).alias("chunk"), dealt("doc_id", buckets).alias("bucket"), F.col("doc_id").cast("long").alias("id"), F.length("text").alias("len"), F.lower("text").alias("low"), F.lit(None).cast("array<string>").alias("terms"))
    met = left.unionAll(right).repartitionById(chunks * buckets, F.col("chunk") * buckets + F.col("bucket")).sortWithinPartitions("chunk", "bucket", F.col("len").asc_nulls_first(), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, at = None, None
        for x in batches:
            for r in (r for j in range(0, x.num_rows, 256) for r in x.slice(j, 256).to_pylist()):
                if (r["chunk"], r["bucket"]) != at:
                    if block:
                        yield from block.result()
                    block, at = _Block(k), (r["chunk"], r["bucket"])
                block.add(r)
        if block:
            yield from block.result()

    found = met.mapInArrow(run, "query_id long, doc_id long, match_count long, len int")
    if shared:
        found = found.unionByName(ranked(keyword_matches(rows.join(repeated, "doc_id", "left_semi"), wanted), k, F.desc("match_count"), F.col("len"), F.col("doc_id")).select("query_id", "doc_id", "match_count", "len"))
    return ranked(found, k, F.desc("match_count"), F.col("len"), F.col("doc_id"))


class _Words(dict):
    """Numbers by their words; a new word takes the next."""

    def __missing__(self, word: str | bytes) -> int:
        self[word] = n = len(self)
        return n


class _Block:
    """Queries, then documents by length and id: the first k of each query by the number of its terms that they hold.

    A term lies within a run of bytes that terms are made of. Such words come again and again, so a text is cut into them and each is
    searched for terms once. Which of a span's documents hold a term is a row of bits; a query's rows are added up bit by bit of the
    sums, for 64 documents at a time, and of the largest sums the first documents are taken.
    """

    def __init__(self, k: int) -> None:
        self.k, self.queries, self.known, self.terms, self.ready, self.held, self.characters = k, [], _Words(), [], False, [], 0

    def add(self, row: dict) -> None:
        if row["low"] is None:
            self.queries.append(row["id"])
            self.terms.append([self.known[t] for t in row["terms"]])
        elif self.queries:
            if not self.ready:
                self._start()
            self.held.append(row)
            self.characters += len(row["low"])
            if len(self.held) >= self.at_once or self.characters >= CHARACTERS or self.placed + len(self.held) >= self.span:
                self._search()

    def _start(self) -> None:
        import numpy as np

        known = [t.encode("utf-8", "surrogatepass") for t in self.known]
        # queries as rows of numbers of terms; the last number is no term's
        self.asked = np.full((len(self.terms), max(map(len, self.terms))), len(known), np.int32)
        for i, ts in enumerate(self.terms):
            self.asked[i, : len(ts)] = ts
        self.known, self.terms, self.by_length, self.ready = None, [], {}, True
        lengths = np.array([len(t) for t in known])
        for n in np.unique(lengths).tolist():
            numbers = np.flatnonzero(lengths == n)
            spelled = np.frombuffer(b"".join(known[i] for i in numbers), np.uint8).reshape(-1, n)
            keys = np.zeros(len(numbers), np.uint64)
            for j in range(n):
                keys = _rolled(keys, spelled[:, j])
            order = np.argsort(keys, kind="stable")
            sieve = np.zeros(1 << 20, bool)
            sieve[_slot(keys)] = True
            self.by_length[n] = keys[order], numbers[order], spelled[order], sieve
        letters = set(b"".join(known))
        self.table = bytes(x if x in letters else GAP[0] for x in range(256))
        self.span = max(64, min(SPAN, CELLS * 8 // (len(known) + 1)) // 64 * 64)
        self.at_once = max(1, min(AT_ONCE, CELLS // (len(known) + 1)))
        self.bits = np.zeros((len(known) + 1, self.span // 64), np.uint64)
        self.placed, self.places = 0, []
        shape = (len(self.queries), self.k)
        self.counts, self.ids, self.lens = np.zeros(shape, np.int32), np.zeros(shape, np.int64), np.zeros(shape, np.int32)
        self._forget()

    def _forget(self) -> None:
        import numpy as np

        # the words so far; of each, where its terms begin and how many they are; the terms
        self.words, self.first, self.n, self.found, self.letters = _Words(), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), 0

    def _held_terms(self, words: list[bytes]):
        """(word, term) of every term that a word holds, by word."""
        import numpy as np

        letters = np.frombuffer(b"".join(words), np.uint8)
        sizes = np.array([len(w) for w in words])
        of = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        ends = np.repeat(np.cumsum(sizes), sizes)
        at, keys, found = np.arange(len(letters)), np.zeros(len(letters), np.uint64), [(np.zeros(0, np.int32), np.zeros(0, np.int32))]
        for size in range(1, max(self.by_length) + 1):
            if not (within := at + size <= ends).all():
                at, keys, ends = at[within], keys[within], ends[within]
            keys = _rolled(keys, letters[at + (size - 1)])
            if size not in self.by_length:
                continue
            own, numbers, spelled, sieve = self.by_length[size]
            some = np.flatnonzero(sieve[_slot(keys)])
            first, last = np.searchsorted(own, keys[some]), np.searchsorted(own, keys[some], side="right")
            for step in range(int((last - first).max(initial=0))):  # terms with equal keys, rarely more than one
                more = first + step < last
                place, term = at[some[more]], (first + step)[more]
                same = (letters[place[:, None] + np.arange(size)] == spelled[term]).all(1)  # equal keys don't prove equal letters
                found.append((of[place[same]], numbers[term[same]].astype(np.int32)))
        word, term = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(word, kind="stable")
        return word[order], term[order]

    def _search(self) -> None:
        """Sets the bits of the documents at hand."""
        import numpy as np

        rows, self.held, self.characters = self.held, [], 0
        if len(self.words) > WORDS or self.letters > LETTERS:
            self._forget()
        known, number = len(self.words), self.words.__getitem__
        own = [list(map(number, set(r["low"].encode("utf-8", "surrogatepass").translate(self.table).split(GAP)))) for r in rows]
        if new := list(islice(self.words, known, None)):
            word, term = self._held_terms(new)
            n = np.bincount(word, minlength=len(new))
            self.first = np.concatenate([self.first, len(self.found) + np.cumsum(n) - n])
            self.n, self.found, self.letters = np.concatenate([self.n, n]), np.concatenate([self.found, term]), self.letters + sum(map(len, new))
        word, doc = np.concatenate([np.array(x) for x in own]), np.repeat(np.arange(len(own)), [len(x) for x in own])
        n = self.n[word]
        term = self.found[np.repeat(self.first[word] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        place = np.zeros(len(self.bits), np.int32)
        place[term] = 1
        used = np.flatnonzero(place)
        place[used] = np.arange(len(used))
        low, high = self.placed // 64, -(-(self.placed + len(rows)) // 64)
        holds = np.zeros((len(used), (high - low) * 64), bool)
        holds[place[term], np.repeat(doc + (self.placed - low * 64), n)] = True
        self.bits[used, low:high] |= np.packbits(holds, axis=1, bitorder="little").view("<u8")
        self.places += [(r["id"], r["len"]) for r in rows]
        self.placed += len(rows)
        if self.placed >= self.span:
            self._count()

    def _count(self) -> None:
        """Takes the best documents of the span that ends here."""
        import numpy as np

        bits, places = self.bits[:, : -(-self.placed // 64)], np.array(self.places, np.int64)
        # documents come by length and id, so only one with more terms than the k-th so far takes a place
        most = bits.any(axis=1)[self.asked].sum(axis=1)
        some = np.flatnonzero(most > self.counts[:, -1])
        for a in range(0, len(some), COUNTED):
            rows = some[a : a + COUNTED]
            counts, at = self._best(bits, self.asked[rows], self.counts[rows, -1], int(most[rows].max()))
            new = np.flatnonzero(counts[:, 0])
            rows, counts, at = rows[new], counts[new], at[new]
            counts = np.concatenate([self.counts[rows], counts], axis=1)
            order = np.argsort(-counts, axis=1, kind="stable")[:, : self.k]
            self.counts[rows] = np.take_along_axis(counts, order, axis=1)
            for name, column in (("ids", 0), ("lens", 1)):
                both = np.concatenate([getattr(self, name)[rows], places[at, column]], axis=1)
                getattr(self, name)[rows] = np.take_along_axis(both, order, axis=1)
        self.bits[:], self.placed, self.places = 0, 0, []

    def _best(self, bits, asked, floor, most: int):
        """The counts, and places in the span, of each query's first k documents by count and place, of those with more terms than its floor."""
        import numpy as np

        sums = []  # a digit of the sums each
        for j in range(asked.shape[1]):
            carry = bits[asked[:, j]]
            for digit in sums:
                over = digit & carry
                digit ^= carry
                carry = over
            if j + 1 >> len(sums):
                sums.append(carry)
        shape = (len(asked), self.k)
        counts, at, taken, left = np.zeros(shape, np.int32), np.zeros(shape, np.int64), np.zeros(len(asked), np.int64), np.arange(len(asked))
        for count in range(most, 0, -1):
            left = left[(taken[left] < self.k) & (floor[left] < count)]
            equal = None
            for b, digit in enumerate(sums):
                x = digit[left] if len(left) < len(asked) else digit
                x = x if count >> b & 1 else ~x
                equal = x if equal is None else equal & x
            own = np.flatnonzero(equal.any(axis=1))
            own, equal = left[own], equal[own]
            while len(own):
                word = (equal != 0).argmax(axis=1)
                value = equal[np.arange(len(own)), word]
                lowest = value & (~value + np.uint64(1))
                counts[own, taken[own]] = count
                at[own, taken[own]] = word * 64 + np.bitwise_count(lowest - np.uint64(1))
                taken[own] += 1
                equal[np.arange(len(own)), word] = value ^ lowest
                more = np.flatnonzero((taken[own] < self.k) & equal.any(axis=1))
                own, equal = own[more], equal[more]
        return counts, at

    def result(self) -> Iterator[pa.RecordBatch]:
        import numpy as np

        if self.held:
            self._search()
        if self.ready:
            if self.placed:
                self._count()
            q, j = np.nonzero(self.counts)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(self.queries, np.int64)[q]), pa.array(self.ids[q, j]), pa.array(self.counts[q, j].astype(np.int64)), pa.array(self.lens[q, j])], names=["query_id", "doc_id", "match_count", "len"])


def _rolled(keys, letters):
    """Keys of texts that are one letter longer."""
    import numpy as np

    return keys * np.uint64(0x1FFFFFFFFFFFFF7) + letters.astype(np.uint64) + np.uint64(1)


def _slot(keys):
    import numpy as np

    return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)
