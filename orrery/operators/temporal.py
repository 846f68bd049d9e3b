"""Joins by time: the version in force at an instant, and instants or periods that meet periods.

Times are dates, timestamps or whole numbers; a period is half-open, [start, end), one without an end has not ended, and one
that ends where it starts, or before, meets nothing. Rows whose key or time is null match nothing.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F

from orrery.operators.lineage import cut

#: A key with more rows than HOT is cut into CUTS buckets of time. A period lies in at most SPREAD + 1 bins of its level, and bins of the next level are SPREAD times as wide.
HOT, CUTS, SPREAD, SALTS = 1_000_000, 64, 8, 64
#: Day, hour, minute, second and thousandth in ticks, each a multiple of the next.
UNITS = (86_400_000_000, 3_600_000_000, 60_000_000, 1_000_000, 1000)


def ticks(df: DataFrame, c: str) -> Column:
    """A time as a whole number: microseconds of dates and timestamps, numbers as they are."""
    kind = df.schema[c].dataType.typeName()
    if kind in ("date", "timestamp_ntz"):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(c).cast("timestamp_ntz"))
    return F.unix_micros(c) if kind == "timestamp" else F.col(c).cast("long")


def _known(*names: str) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & F.col(n).isNotNull()
    return out


def asof_join(left: DataFrame, right: DataFrame, on: list[str], at: str, since: str, values: list[str], how: str = "left", tolerance: timedelta | int | None = None, hot: int = HOT) -> DataFrame:
    """left with ``values`` of the row of right with equal ``on`` whose ``since`` is the latest not after ``at``; of equal ones the largest by its values.

    Both sides are dealt by key, once, and one running window takes the last version along. The rows of a key that has more
    than ``hot`` of them are dealt by buckets of time as well: a bucket starts with what the ones before it hand on, which a
    small table of one row for each such key and bucket tells. ``tolerance`` is how old a version may be.
    """
    if clash := set(values) & set(left.columns):
        raise ValueError(f"both sides have {sorted(clash)}")
    version = F.struct(F.col("t").alias("since"), *values)
    events = left.select(F.struct(*left.columns).alias("row"), *on, ticks(left, at).alias("t"))
    versions = right.withColumn("t", ticks(right, since)).where(_known(*on, "t")).select(*on, "t", version.alias("version"))
    usable = events.where(_known(*on, "t"))

    keys = cut(usable.select(*on).unionAll(versions.select(*on)).groupBy(*on).agg(F.count("*").alias("n")).where(F.col("n") > hot).select(*on, F.lit(True).alias("cut")))
    handed = None
    if keys.isEmpty():
        usable, versions = (df.withColumn("bucket", F.lit(0)) for df in (usable, versions))
    else:
        found = usable.join(keys, on, "left_semi").agg(F.percentile_approx("t", [k / CUTS for k in range(1, CUTS)], 10_000).alias("cuts")).first()
        cuts = F.array(*(F.lit(c).cast("long") for c in sorted(set(found["cuts"] or ()))))
        bucket = F.when(F.col("cut"), F.size(F.filter(cuts, lambda c: c <= F.col("t")))).otherwise(0)
        usable, versions = (df.join(keys, on, "left").withColumn("bucket", bucket) for df in (usable, versions))
        ends = versions.where("cut").groupBy(*on, "bucket").agg(F.max("version").alias("version"))
        following = F.lead("bucket", 1, CUTS).over(Window.partitionBy(*on).orderBy("bucket"))
        handed = ends.withColumn("next", following).where("bucket < next").select(*on, F.explode(F.sequence(F.col("bucket") + 1, "next")).alias("bucket"), "version")

    side = lambda df, n, t, *more: df.select(*on, "bucket", t.alias("t"), F.lit(n).alias("side"), *more)
    none, start = F.lit(None), F.lit(-(2**63)).cast("long")
    rows = side(usable, 2, F.col("t"), none.alias("version"), "row")
    rows = rows.unionAll(side(versions, 1, F.col("t"), "version", none.alias("row")))
    if handed is not None:
        rows = rows.unionAll(side(handed, 0, start, "version", none.alias("row")))
    running = Window.partitionBy(*on, "bucket").orderBy("t", "side", "version").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = rows.withColumn("version", F.last("version", ignorenulls=True).over(running)).where("side = 2")
    if tolerance is not None:
        limit = tolerance // timedelta(microseconds=1) if isinstance(tolerance, timedelta) else tolerance
        found = found.withColumn("version", F.when(F.col("t") - F.col("version.since") <= limit, F.col("version")))
    found = found.select("row.*", *(F.col("version")[v].alias(v) for v in values), F.col("version").isNotNull().alias("matched by time"))
    if how == "inner":
        return found.where(F.col("matched by time")).drop("matched by time")
    kinds = {f.name: f.dataType for f in right.schema}
    unmatched = events.where(~_known(*on, "t")).select("row.*", *(F.lit(None).cast(kinds[v]).alias(v) for v in values))
    return found.drop("matched by time").unionAll(unmatched)


def period_join(points: DataFrame, periods: DataFrame, at: str, start: str, end: str, on: list[str] | None = None) -> DataFrame:
    """Each pair of a point and a period with start <= at < end and equal ``on``.

    Bins make it an equi-join. Periods lie on levels: bins of the lowest are as wide as the median period, and a period takes
    the lowest level on which it touches at most SPREAD + 1 bins, so long ones are apart from short ones and none is copied more
    often than that. A point looks into its bin on each level that is in use. Wide bins, whose periods are
    long, are split by salts, so that a level's points are dealt as evenly as those of the lowest.
    """
    on = on or []
    if clash := (set(points.columns) & set(periods.columns)) - set(on):
        raise ValueError(f"both sides have {sorted(clash)}")
    p = points.withColumn("p t", ticks(points, at)).where(_known("p t", *on))
    s = periods.withColumn("s from", ticks(periods, start)).withColumn("s to", ticks(periods, end)).where(_known("s from", *on))
    latest = p.agg(F.max("p t").alias("latest")).first()["latest"]
    s = s.withColumn("s to", F.when(F.col(end).isNull(), F.lit(latest if latest is not None else 0) + 1).otherwise(F.col("s to"))).where("`s from` < `s to`")
    length = F.col("s to") - F.col("s from")
    shape = s.agg(F.percentile_approx(length, 0.5).alias("width"), F.max(length).alias("longest")).first()
    if not shape["width"]:
        return p.drop("p t").join(s.drop("s from", "s to"), on or F.lit(True)).limit(0)
    widths = [max(1, shape["width"])]
    while widths[-1] * SPREAD < shape["longest"]:
        widths.append(widths[-1] * SPREAD)
    salts = [min(SPREAD**k, SALTS) for k in range(len(widths))]
    choose = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("level") + 1)
    level = F.size(F.filter(F.array(*(F.lit(w * SPREAD) for w in widths)), lambda w: w < length))
    bins = lambda t: F.expr(f"`{t}` div width").cast("long") - F.when(F.expr(f"`{t}` % width < 0"), 1).otherwise(0)
    s = s.withColumn("s last", F.col("s to") - 1).withColumn("level", level).withColumn("width", choose(widths))
    s = s.withColumn("bin", F.explode(F.sequence(bins("s from"), bins("s last"))))
    s = s.withColumn("salt", F.explode(F.sequence(F.lit(0), choose(salts) - 1)))
    p = p.withColumn("level", F.explode(F.array(*map(F.lit, range(len(widths)))))).withColumn("width", choose(widths)).withColumn("bin", bins("p t"))
    p = p.withColumn("salt", F.pmod(F.xxhash64("p t", *points.columns), choose(salts)).cast("int"))
    met = p.drop("width").join(s.drop("width", "s last"), [*on, "level", "bin", "salt"]).where("`p t` >= `s from` and `p t` < `s to`")
    return met.drop("p t", "s from", "s to", "level", "bin", "salt")


def overlap_join(a: DataFrame, b: DataFrame, a_span: tuple[str, str], b_span: tuple[str, str], on: list[str] | None = None) -> DataFrame:
    """Each pair of periods with a common instant, once: b starts within a, or a starts within b after b does."""
    begun = period_join(b.where(_alive(b, b_span)), a, b_span[0], *a_span, on=on)
    later = period_join(a.where(_alive(a, a_span)), b, a_span[0], *b_span, on=on).where(F.col(a_span[0]) > F.col(b_span[0]))
    return begun.unionByName(later)


def _alive(df: DataFrame, span: tuple[str, str]) -> Column:
    return F.col(span[0]).isNotNull() & (F.col(span[1]).isNull() | (F.col(span[0]) < F.col(span[1])))


def totals(points: DataFrame, periods: DataFrame, at: str, start: str, end: str, by: list[str], values: dict[str, tuple[str, Column]]) -> DataFrame:
    """(by, values): what the points with start <= at < end come to, for each ``by`` of the periods that meet any. Pairs are never made.

    ``values`` name a kind (sum, min or max) and a column of the points. Points are added up by bins of widths that are powers of SPREAD, and a period
    is cut into the fewest such bins, a few dozen; those it meets by an equi-join.
    """
    p = points.withColumn("p t", ticks(points, at)).where("`p t` is not null").groupBy("p t").agg(*_merged(values, True))
    s, unit, levels = _cut_into_bins(periods, start, end, p.agg(F.max("p t")).first()[0], p)
    return _added(_climbed(p, unit, levels), s, by, values)


def stabbed(points: DataFrame, periods: DataFrame, at: str, start: str, end: str, by: list[str], values: dict[str, tuple[str, Column]]) -> DataFrame:
    """(by, values): as totals(), the other way round: what the periods with start <= at < end come to, for each ``by`` of the points; ``values`` are of the periods."""
    p = points.withColumn("p t", ticks(points, at)).where("`p t` is not null").select("p t", *by)
    s = periods.groupBy(start, end).agg(*_merged(values, True))
    s, unit, levels = _cut_into_bins(s, start, end, p.agg(F.max("p t")).first()[0], p)
    return _added(s, _climbed(p, unit, levels), by, values)


def _climbed(p: DataFrame, unit: int, levels: int) -> DataFrame:
    """The points, once in a bin of each level."""
    widths = F.array(*(F.lit(unit * SPREAD**k) for k in range(levels)))
    bins = p.select("*", F.posexplode(widths).alias("level", "width")).withColumn("bin", F.expr("(`p t` - pmod(`p t`, width)) div width"))
    return bins.drop("p t", "width")


def _cut_into_bins(periods: DataFrame, start: str, end: str, latest: int | None, p: DataFrame) -> tuple[DataFrame, int, int]:
    """The periods, once for each of the bins (level, bin) that make them up, the least width, and how many levels there are."""
    last = (latest if latest is not None else 0) + 1
    s = periods.withColumn("s from", ticks(periods, start)).withColumn("s to", F.when(F.col(end).isNull(), F.lit(last)).otherwise(ticks(periods, end))).where("`s from` < `s to`")
    # times that are whole days, hours, minutes, seconds or thousandths need no finer bins; the end of time may be any
    unit, longest = _step(s, F.col("s from"), F.when(F.col(end).isNotNull(), F.col("s to"))), s.agg(F.max(F.col("s to") - F.col("s from"))).first()[0]
    s = s.withColumn("s to", F.expr(f"(`s to` + pmod(-`s to`, {unit}))"))  # no point lies between the latest and the unit's end
    levels = 1
    while unit * SPREAD**levels <= (longest or 0):
        levels += 1
    up = lambda c, w: f"(({c} + pmod(-{c}, {w})) div {w})"
    down = lambda c, w: f"(({c} - pmod({c}, {w})) div {w})"
    parts = []
    for k in range(levels):
        w = f"{unit * SPREAD**k}L"
        a, b = up("`s from`", w), down("`s to`", w)
        if k == levels - 1:
            parts.append(f"if({a} < {b}, sequence({a}, {b} - 1), array())")
            continue
        wide = f"{unit * SPREAD ** (k + 1)}L"
        x, y = f"{up('`s from`', wide)} * {SPREAD}", f"{down('`s to`', wide)} * {SPREAD}"
        some = lambda a, b: f"if({a} < {b}, sequence({a}, {b} - 1), array())"
        parts.append(f"if({x} <= {y}, concat({some(a, x)}, {some(y, b)}), {some(a, b)})")
    s = s.select("*", F.posexplode(F.array(*(F.expr(p).cast("array<bigint>") for p in parts))).alias("level", "bins")).withColumn("bin", F.explode("bins"))
    return s.drop("bins", "s from", "s to", start, end), unit, levels


def _merged(values: dict[str, tuple[str, Column]], raw: bool = False) -> list[Column]:
    return [getattr(F, kind)(c if raw else n).alias(n) for n, (kind, c) in values.items()]


def _step(df: DataFrame, *times: Column) -> int:
    """The largest of UNITS that all times are multiples of."""
    found = df.agg(*(F.count_if(F.exists(F.array(*times), lambda t: t % u != 0)).alias(f"u{u}") for u in UNITS)).first()
    return next((u for u in UNITS if not found[f"u{u}"]), 1)


def _added(binned: DataFrame, asked: DataFrame, by: list[str], values: dict[str, tuple[str, Column]]) -> DataFrame:
    """Values of equal bins together first, then those of all bins that one ``by`` asks for."""
    bins = binned.groupBy("level", "bin").agg(*_merged(values))
    return asked.select(*by, "level", "bin").join(bins, ["level", "bin"]).groupBy(*by).agg(*_merged(values))


def overlap_totals(a: DataFrame, b: DataFrame, a_span: tuple[str, str], b_span: tuple[str, str], by: list[str], values: dict[str, tuple[str, Column]]) -> DataFrame:
    """(by, values): what the periods b that have an instant in common with periods a come to, for each ``by`` of a: those that start within a, and those that hold a's start and start before it."""
    a, b = a.where(_alive(a, a_span)), b.where(_alive(b, b_span))
    within = totals(b, a, b_span[0], *a_span, by, values)
    step = min(_step(a, ticks(a, a_span[0])), _step(b, ticks(b, b_span[0])))  # no start of a lies between a start of b and a step later
    later = b.withColumn("after start", ticks(b, b_span[0]) + step).withColumn("its end", F.when(F.col(b_span[1]).isNotNull(), ticks(b, b_span[1]))).where("`its end` is null or `after start` < `its end`")
    holding = stabbed(a.withColumn("own start", ticks(a, a_span[0])), later, "own start", "after start", "its end", by, values)
    return within.unionByName(holding).groupBy(*by).agg(*_merged(values))
