import random
import re

from pyspark.sql import functions as F

from orrery.llm import lines


def edited(r, text, n):
    t = list(text)
    for _ in range(n):
        k, how = r.randrange(len(t) + 1), r.randrange(3)
        if how == 0:
            t.insert(k, r.choice("abcé"))
        elif k < len(t):
            t[k : k + 1] = [r.choice("abcé")] if how == 1 else []
    return "".join(t)


def test_bit_parallel_distance(spark):
    r = random.Random(2)
    rows = []
    for _ in range(800):
        a = "".join(r.choice("abé") for _ in range(r.choice([0, 1, 2, 5, 12, 40])))
        rows.append((a, edited(r, a, r.randint(0, 4))))
    df = spark.createDataFrame(rows, "a string, b string").withColumn("t", F.levenshtein("a", "b"))
    for n in (1, 2, 3):
        out = df.where(f"abs(length(a) - length(b)) <= {n}").withColumn("d", lines.bit_parallel(F.col("a"), F.col("b"), n))
        assert out.where(f"(t <= {n} and d <> t) or (t > {n} and d <= {n})").count() == 0


def test_against_brute_force(spark):
    r = random.Random(7)
    base = ["".join(r.choice("abcdefgh é") for _ in range(r.randint(12, 60))) for _ in range(40)]
    docs = [(k, "\n".join(r.choice(["", "x", r.choice(base), edited(r, r.choice(base), r.randint(1, 3))]) for _ in range(r.randint(0, 8)))) for k in range(60)]
    every = [(i, k, s) for i, t in docs for k, s in enumerate(t.split("\n")) if s.strip()]

    def edit(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    distinct = sorted({s for _, _, s in every})
    most = lambda n: 2 if n >= 30 else 1 if n >= 15 else 0
    near = {(a, b) for a in distinct for b in distinct if a == b or (abs(len(a) - len(b)) <= 2 and edit(a, b) <= most(min(len(a), len(b))))}
    gone = {(i, k) for n, (i, k, s) in enumerate(every) if any((s, t) in near for _, _, t in every[:n])}
    expected = {i: "\n".join(s for k, s in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in docs}
    out = lines.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {x.doc_id: x.text for x in out} == expected


def test_keys_of_two_edits_at_the_ends(spark):
    """Plain numbers, eleven a line, are the keys; a letter taken from either end segment and one put into the other are found, wherever they are."""
    r = random.Random(4)
    pairs = []
    for n in (30, 31, 32, 45):
        for _ in range(60):
            a = "".join(r.choice("abcdé") for _ in range(n))
            x, y = sorted(r.sample(range(n), 2))
            b = r.choice([a[:x] + r.choice("abé") + a[x:y] + a[y + 1 :], a[:x] + a[x + 1 : y] + r.choice("abé") + a[y:]])
            pairs += [(a, b)] if a != b else []
    df = spark.createDataFrame([(t,) for t in sorted({t for p in pairs for t in p})], "line string").select(F.xxhash64("line").alias("h"), F.xxhash64(F.lit(7), "line").alias("g"), "line")
    keys = df.withColumn("n", F.length("line")).select(lines.segment_keys().alias("k"))
    assert keys.schema["k"].dataType.elementType.simpleString() == "bigint" and {len(r.k) for r in keys.collect()} == {11}
    names = {r.h: r.line for r in df.collect()}
    found = {frozenset((names[r.a], names[r.b])) for r in lines.near_pairs(df).select("a", "b").collect()}
    assert len(pairs) > 200 and {frozenset(p) for p in pairs} <= found


def test_keys_are_compiled(spark, capsys):
    """Keys as rows are those of the arrays, below, at and above the length from which two edits are allowed, and no method that makes them exceeds the 8000 bytes that the JVM compiles."""
    r = random.Random(5)
    texts = ["".join(r.choice("abcdé😀") for _ in range(n)) for n in (15, 16, 29, 30, 30, 31, 32, 45, 400)]
    df = spark.createDataFrame([(k, t, len(t)) for k, t in enumerate(texts)], "h long, line string, n int")
    arrays = df.select("h", "n", lines.segment_keys().alias("two"), lines.segment_keys(1).alias("one")).collect()
    expected = sorted((x.h, k >> 1, k & 1 == 1) for x in arrays for k in (x.two if x.n >= 30 else []) + (x.one if x.n <= 30 else []))
    assert sorted(tuple(x) for x in lines.keyed(df).collect()) == expected
    assert spark.conf.get("spark.sql.codegen.wholeStage") == "true"
    capsys.readouterr()
    lines.keyed(df).explain("codegen")
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) <= 8000


def test_hot_keys_against_brute_force(spark):
    """Lines that share much: pairs found by two segments of four are those that one of three finds."""
    r = random.Random(9)
    texts = sorted({edited(r, "a common beginning of many lines " + "".join(r.choice("ab") for _ in range(r.randint(4, 7))) + " and their common end", r.randint(0, 2)) for _ in range(300)})
    df = spark.createDataFrame([(t,) for t in texts], "line string").select(F.xxhash64("line").alias("h"), F.xxhash64(F.lit(7), "line").alias("g"), "line")
    a, b = ({(x.a, x.b) for x in lines.near_pairs(df, hot=n).collect()} for n in (3, 10**6))
    true = df.alias("x").join(df.alias("y"), F.expr("x.h < y.h and levenshtein(x.line, y.line) <= 2")).select("x.h", "y.h").collect()
    assert a == b == {tuple(x) for x in true} and len(a) > 300


def test_rows_without_their_own_id(spark):
    """Rows with a null or repeated id lose only lines that stand elsewhere too."""
    rows = [(None, "shared by the two of them, a long line\nkeep A"), (None, "only here and nowhere else at all\nkeep B"), (7, "shared by the two of them, a long line\nx"), (7, "another text with that id altogether\ny")]
    out = {x.text for x in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {"keep A", rows[1][1], rows[2][1], rows[3][1]}


def test_plan_is_native(spark, odd):
    plan = lines.dedup(odd())._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_odd_rows(odd, none):
    out = lines.dedup(odd("dropped", "line")).collect()
    by = {x.doc_id: x for x in out}
    assert len(out) == 9 and by[1].text is None and by[2].text == "" and by[6].text == "\n\n \n\t"
    assert by[3].text != "" and by[4].text == "" and by[4].n_dropped == 1
    assert lines.dedup(none).count() == 0
