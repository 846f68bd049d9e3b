"""Line dedup by a segment-partition edit join, in DataFrame operations throughout.

A line goes if an equal line, or one within the edits allowed, comes earlier (by document id, then the text's
hash, then position); lines are judged on the input, not on what is left. ``EDITS`` edits are allowed where the
shorter line has ``LEAST`` characters or more, one from ``ONE`` characters on, none below; blank lines stay.

The join: all occurrences of a line are first one row. A line is cut into threshold-plus-one segments. One of
them is left whole by that many edits, so near lines share a segment at a place that their lengths and the
segment's number bound. Index rows carry a line's own segments by (length, number, text), probe rows the
substrings that a longer or equally long line can match them with. Keys that several lines share give the
candidate lines; only these fetch their text. Lines of a key that more than ``HOT`` lines share are cut once more:
of threshold-plus-two segments two are left whole, and pairs of those are the keys. Candidate pairs pass a
letter-count filter inside the join, and banded bit-parallel edit distance decides.

Decisions go back to a line's occurrences by an equi-join. Lines with over a ``SHARE``-th of all occurrences
(at most ``SHARE`` of them, so they may be broadcast) are joined apart, so no task gets more than that share of one
line. What grows with the corpus is shuffled at every size, so that a small run's plan is a large run's too.

Defined cases: null text stays null and empty text empty; of repeated lines in one document the first stays;
rows that share an id are told apart by their text, so each keeps or loses its own lines, and exact repeats of a
row keep the same lines; rows whose id is null come after all others; an empty table gives an empty one; further
columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from orrery.llm.shared import saved

EDITS, LEAST, ONE = 2, 30, 15
#: Lines of a key from which it is cut once more; the share of all occurrences from which a line's are joined apart.
HOT, SHARE = 50, 10_000
#: Letters that the count filter tells apart.
CLASSES = ("aA", "bBcC", "dD", "eE", "fFgG", "hH", "iIjJ", "kKlL", "mM", "nN", "oO", "pPqQ", "rR", "sS", "tT", "uUvVwWxXyYzZ")


def _identity(text: str, key: str) -> Column:
    """What tells rows apart: the id, whether it is null, and the text's hash."""
    return F.struct(F.col(key).isNull().alias("last"), F.col(key).alias("key"), F.xxhash64(text).alias("t"))


def occurrences(df: DataFrame, text: str, key: str) -> DataFrame:
    """(row, at, line, h, g): the lines of all documents, with two hashes that stand for their text."""
    lines = df.select(_identity(text, key).alias("row"), F.posexplode(F.split(text, "\n", -1)).alias("at", "line")).where(F.col("line").rlike(r"\S"))
    return lines.select("row", "at", "line", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(7), "line").alias("g"))


def _cut(n: Column, i: int | Column, pieces: int | Column) -> Column:
    return F.floor(n * i / pieces).cast("int")


def segment_cases(edits: int = EDITS) -> list[Column]:
    """(e, d, i, x): a line of length n looks for lines of length n - d, with e edits, by its own text at their segment i, moved by x.

    Two edits between lines of one length that leave neither end segment whole are one in each, so each line holds the other's middle, moved by opposite
    steps; one direction is enough.
    """
    out = []
    for d in range(edits + 1):
        for i in range(edits + 1):
            for shift in range(max(-i, d - (edits - i)), min(i, d + (edits - i)) + 1):
                if edits == 2 and d == 0 and shift < 0:
                    continue
                out.append(F.struct(*(F.lit(v).alias(k) for k, v in zip("edix", (edits, d, i, shift)))))
    return out


def segment_key(c: Column) -> Column:
    """The key of a line's case, a number whose lowest bit tells a line's own."""
    n, pieces = F.col("n") - c["d"], c["e"] + 1
    start = _cut(n, c["i"], pieces)
    key = F.xxhash64(n, c["i"], c["e"], F.substring("line", start + 1 + c["x"], _cut(n, c["i"] + 1, pieces) - start))
    return key.bitwiseAND(F.lit(-2)).bitwiseOR(((c["d"] == 0) & (c["x"] == 0)).cast("long"))


def segment_keys(edits: int = EDITS) -> Column:
    """Keys of a line's index and probe rows, as one array."""
    return F.array(*(segment_key(c) for c in segment_cases(edits)))


def keyed(lines: DataFrame, edits: int = EDITS, least: int = LEAST, one: int = ONE) -> DataFrame:
    """(h, k, own): the segment keys of lines (h, line, n), a row each.

    Cases become rows before their keys are computed. As elements of one array their code is one method, too long for the JVM to compile.
    """
    cases = F.array(*segment_cases(edits))
    if one < least:  # lines of just ``least`` characters also look for shorter ones
        shorter = F.array(*segment_cases(1))
        cases = F.when(F.col("n") > least, cases).when(F.col("n") == least, F.concat(cases, shorter)).otherwise(shorter)
    found = lines.select("h", "line", "n", F.explode(cases).alias("c")).select("h", segment_key(F.col("c")).alias("s"))
    return found.select("h", F.shiftright("s", 1).alias("k"), (F.col("s").bitwiseAND(F.lit(1)) == 1).alias("own"))


def pair_keys(edits: int = EDITS) -> Column:
    """As segment_keys, by two of threshold-plus-two segments: edits move the second no further than they may."""
    pieces, cases = edits + 2, []
    for d in range(edits + 1):
        for i in range(pieces):
            for j in range(i + 1, pieces):
                for x in range(-edits, edits + 1) if i else (0,):
                    for y in range(-edits, edits + 1) if j < pieces - 1 else (d,):
                        if abs(x) + abs(y - x) + abs(d - y) <= edits:
                            cases.append(F.struct(*(F.lit(v).alias(k) for k, v in zip("dijxy", (d, i, j, x, y)))))

    def key(c: Column) -> Column:
        n = F.col("n") - c["d"]
        cut = lambda k: F.floor(n * k / pieces).cast("int")
        segment = lambda k, shift: F.substring("line", cut(k) + 1 + shift, cut(k + 1) - cut(k))
        own = (c["d"] == 0) & (c["x"] == 0) & (c["y"] == 0)
        return F.struct(F.xxhash64(n, c["i"], c["j"], segment(c["i"], c["x"]), segment(c["j"], c["y"])).alias("k"), own.alias("own"))

    return F.transform(F.array(*cases), key)


def bit_parallel(a: Column, b: Column, edits: int = EDITS) -> Column:
    """Edit distance of two texts whose lengths differ by ``edits`` at most, if it is ``edits`` or less; else something larger.

    A column's window of 2 * edits + 2 bits runs along the diagonal; vp and vn hold where the vertical
    difference is plus or minus one. The score follows the window's lowest row to the end of a, then a's last row.
    """
    width = 2 * edits + 2
    mask = (1 << width) - 1
    # a common beginning changes no distance, and with it neither text is shorter than the threshold
    left, right = F.split(F.concat(F.lit("#" * edits), a), ""), F.split(F.concat(F.lit("#" * edits), b), "")

    def moved(s: Column, i: Column) -> Column:
        c = F.get(s["b"], i)
        match = sum(F.when(F.get(s["a"], i + (edits + 1 - width + k)) == c, F.lit(1 << k)).otherwise(F.lit(0)) for k in range(width))
        # one-element arrays name a value that the next step uses more than once
        with_d0 = F.transform(F.array(match), lambda x: (x.bitwiseAND(s["vp"]) + s["vp"]).bitwiseXOR(s["vp"]).bitwiseOR(x).bitwiseOR(s["vn"]).bitwiseAND(F.lit(mask)))
        return F.transform(with_d0, lambda d0: _next(s, d0, i, edits, width))[0]

    start = F.struct(left.alias("a"), right.alias("b"), F.lit(mask & ~((1 << (width - edits - 1)) - 1)).alias("vp"), F.lit(0).alias("vn"), F.lit(edits).alias("d"))
    return F.aggregate(F.sequence(F.lit(0), F.length(b) + (edits - 1)), start, moved, lambda s: s["d"])


def _next(s: Column, d0: Column, i: Column, edits: int, width: int) -> Column:
    flip = lambda v: v.bitwiseXOR(F.lit((1 << width) - 1))
    hp = s["vn"].bitwiseOR(flip(d0.bitwiseOR(s["vp"])))
    hn = d0.bitwiseAND(s["vp"])
    past = i - (F.size(s["a"]) - edits)  # columns since the window's lowest row left a
    at = lambda v: F.coalesce(F.get(F.array(*(F.shiftright(v, k).bitwiseAND(F.lit(1)) for k in range(width - 2, -1, -1))), past), F.lit(0))
    score = F.when(past < 0, F.when(d0.bitwiseAND(F.lit(1 << (width - 1))) == 0, 1).otherwise(0)).otherwise(at(hp) - at(hn))
    d1 = F.shiftright(d0, 1)
    return F.struct(s["a"].alias("a"), s["b"].alias("b"), hn.bitwiseOR(flip(d1.bitwiseOR(hp))).alias("vp"), d1.bitwiseAND(hp).alias("vn"), (s["d"] + score).alias("d"))


def _shared_start(a: Column, b: Column, steps: int = 30) -> Column:
    """The length of the longest common beginning, by halving steps."""
    same = lambda n: (n <= F.least(F.length(a), F.length(b))) & (F.substring(a, F.lit(1), n) == F.substring(b, F.lit(1), n))
    return F.aggregate(F.array(*(F.lit(1 << k) for k in range(steps, -1, -1))), F.lit(0), lambda n, k: F.when(same(n + k), n + k).otherwise(n))


def _ends_fit(a: Column, b: Column, start: Column, end: Column) -> Column:
    """Whether what lies between the common ends can differ by two edits: one at its first place and one at its last."""
    inner = lambda t, x, y: F.substring(t, start + 1 + x, F.length(t) - start - end - x - y)
    moves = ((1, 1), (1, 0), (0, 1))
    out = F.least(F.length(a), F.length(b)) - start - end <= 1
    for x, p in moves:
        for y, q in moves:
            fits = (F.length(a) - start - end - x - y >= 0) & (F.length(b) - start - end - p - q >= 0)
            out = out | (fits & (F.length(a) - x - y == F.length(b) - p - q) & (inner(a, x, y) == inner(b, p, q)))
    return out


def _joined(side: DataFrame, edits: int) -> DataFrame:
    """(a, b): hashes of different lines (k, h, own, n, c) that share a key, one of them as its own, and have nearly the same letters."""
    a = side.where("own").selectExpr("k", "h a", "n an", "c ac")
    b = side.selectExpr("k", "h b", "n bn", "c bc")
    apart = F.aggregate(F.zip_with("ac", "bc", lambda x, y: F.abs(x - y)), F.lit(0), lambda s, x: s + x)
    found = a.join(b, (a["k"] == b["k"]) & (F.col("a") != F.col("b")) & (F.abs(F.col("an") - F.col("bn")) <= edits) & (apart <= 2 * edits))
    return found.selectExpr("least(a, b) a", "greatest(a, b) b")


def near_pairs(lines: DataFrame, edits: int = EDITS, least: int = LEAST, one: int = ONE, hot: int = HOT) -> DataFrame:
    """(a, ag, b, bg): the hashes of different lines within the edits allowed, each pair once. ``lines`` has (h, g, line), each line once."""
    lines = lines.withColumn("n", F.length("line")).where(F.col("n") >= min(one, least))
    # one shuffle by key, read twice: for the keys that lines share, then for these keys' lines
    keys = keyed(lines, edits, least, one).repartition("k")
    shared = keys.groupBy("k").agg(F.min("h").alias("x"), F.max("h").alias("y"), F.max("own").alias("own"), F.count("*").alias("m")).where("x <> y and own").select("k", "m")
    members = saved(keys.join(shared.hint("shuffle_hash"), "k").groupBy("k", "h").agg(F.max("own").alias("own"), F.max("m").alias("m")), "members")
    wanted = saved(members.groupBy("h").agg(F.max("m").alias("m")), "wanted")
    counts = F.array(*(F.col("n") - F.length(F.translate("line", c, "")) for c in CLASSES))
    # a hash that two lines have brings both along: the distance tells them apart
    texts = saved(lines.join(wanted.hint("shuffle_hash"), "h").withColumn("c", counts), "texts")
    crowd = texts.where((F.col("m") > hot) & (F.col("n") >= least)).select("h", "n", "c", F.explode(pair_keys(edits)).alias("s")).select("h", "n", "c", F.col("s.k").alias("k"), F.col("s.own").alias("own")).groupBy("k", "h", "n", "c").agg(F.max("own").alias("own"))
    # lines under ``least`` characters are few per key: their segments are half of them
    some = members.where(F.col("m") <= hot).unionByName(members.where(F.col("m") > hot).join(texts.where(F.col("n") <= least).select("h"), "h", "left_semi")).select("k", "h", "own")
    # lines of crowded keys carry their letters along, since each has dozens of keys
    pairs = saved(_joined(some.join(texts.select("h", "n", "c"), "h"), edits).unionAll(_joined(crowd, edits)).distinct(), "pairs")
    line = lambda name: texts.select(F.col("h").alias(name), F.col("g").alias(f"{name}g"), F.col("line").alias(f"{name}_line"))
    checked = pairs.join(line("a"), "a").join(line("b"), "b")
    # common ends change no distance; a generated row keeps their lengths from being computed anew at every use, and the distance from being computed before them
    x, y = F.col("a_line"), F.col("b_line")
    checked = checked.withColumn("start", F.explode(F.array(_shared_start(x, y))))
    rest = lambda t: F.reverse(F.substring(t, F.col("start") + 1, F.length(t)))
    checked = checked.withColumn("end", F.explode(F.array(_shared_start(rest(x), rest(y)))))
    if edits <= 2:  # most false candidates differ in more than their ends allow
        checked = checked.where(_ends_fit(x, y, F.col("start"), F.col("end")))
    middle = lambda t: F.substring(t, F.col("start") + 1, F.length(t) - F.col("start") - F.col("end"))
    most = F.when(F.least(F.length(x), F.length(y)) >= least, edits).otherwise(1)
    return checked.where(bit_parallel(middle(x), middle(y), edits) <= most).select("a", "ag", "b", "bg")


def dropped(df: DataFrame, text: str = "text", key: str = "doc_id", edits: int = EDITS, least: int = LEAST, one: int = ONE) -> DataFrame:
    """(row, dropped): the positions of the lines that go, for the rows that lose any."""
    lines = occurrences(df, text, key)
    place = F.struct("row", "at")
    distinct = saved(lines.groupBy("h", "g").agg(F.min(place).alias("first"), F.count("*").alias("n"), F.min("line").alias("line")), "distinct")
    first = distinct.select("h", "g", "first", "n")
    pairs = saved(near_pairs(distinct.select("h", "g", "line"), edits, least, one), "near")
    both = pairs.unionAll(pairs.selectExpr("b a", "bg ag", "a b", "ag bg"))
    near = both.join(first.selectExpr("h b", "g bg", "first"), ["b", "bg"]).groupBy("a", "ag").agg(F.min("first").alias("near")).toDF("h", "g", "near")
    decided = first.join(near.hint("shuffle_hash"), ["h", "g"], "left").select("h", "g", "first", F.coalesce(F.col("near") < F.col("first"), F.lit(False)).alias("too"), "n")
    decided = saved(decided.where("n > 1 or too"), "decided")
    most = (first.agg(F.sum("n")).first()[0] or 0) / SHARE
    slim = lines.select("row", "at", "h", "g")
    hot = F.broadcast(decided.where(F.col("n") > most).select("h", "g", "first", "too"))  # SHARE rows at most
    cold = slim.join(hot, ["h", "g"], "left_anti").join(decided.where(F.col("n") <= most).hint("shuffle_hash"), ["h", "g"])
    goes = F.col("too") | (place != F.col("first"))
    gone = slim.join(hot, ["h", "g"]).where(goes).select("row", "at").unionAll(cold.where(goes).select("row", "at"))
    return saved(gone.groupBy("row").agg(F.collect_set("at").alias("dropped")), "gone")


def dedup(df: DataFrame, text: str = "text", key: str = "doc_id", edits: int = EDITS, least: int = LEAST, one: int = ONE, out: str = "text", count: str | None = "n_dropped") -> DataFrame:
    """df with ``out``, the text without the lines that go, and how many those are."""
    own, row = "lines that go", "row that loses them"  # names that a caller's columns won't have
    gone = dropped(df, text, key, edits, least, one).toDF(row, own)
    same = F.xxhash64(text) == F.col(f"{row}.t")
    joined = df.join(gone.hint("shuffle_hash"), F.col(key).eqNullSafe(F.col(f"{row}.key")) & same, "left").drop(row)
    kept = F.array_join(F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains(own, i)), "\n")
    rows = joined.withColumn(out, F.when(F.col(own).isNull(), F.col(text)).otherwise(kept))
    return (rows.withColumn(count, F.coalesce(F.size(own), F.lit(0)).cast("long")) if count else rows).drop(own)
