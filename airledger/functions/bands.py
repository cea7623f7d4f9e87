"""Spectrum bands as closed intervals in MHz: derivation, classes of width, overlap filters and joins."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Half a hertz, in MHz; the share of a frequency beyond which a bandwidth is a filing error; classes of width.
TOLERANCE, MAX_SHARE, CLASSES = 5e-7, 0.2, (-14, 13)


def plausible_bandwidth(bandwidth: Column, frequency: Column) -> Column:
    """A bandwidth if it is less than a fifth of its frequency, else null."""
    return F.when(bandwidth < F.lit(MAX_SHARE) * frequency, bandwidth)


def occupied(frequency: Column, upper: Column, bandwidth: Column) -> tuple[Column, Column]:
    """(low, high) edges of the occupied band; an upper edge below the frequency is not counted."""
    half = F.coalesce(bandwidth, F.lit(0.0)) / 2
    top = F.when(upper > frequency, upper).otherwise(frequency)
    return frequency - half, top + half


def band_class(low: Column, high: Column) -> Column:
    """The least c from -14 to 13 with a width of at most 2 to the c, else 14; null for null."""
    width, first, last = high - low, *CLASSES
    ladder = F.when(width.isNull(), F.lit(None).cast("int"))
    for c in range(first, last + 1):
        ladder = ladder.when(width <= F.lit(2.0**c), c)
    return ladder.otherwise(last + 1)


def overlaps(low: Column, high: Column, band: tuple[float, float]) -> Column:
    """Whether [low, high] meets a band within half a hertz: two ranges that a Parquet scan can filter by."""
    return (low <= F.lit(band[1] + TOLERANCE)) & (high >= F.lit(band[0] - TOLERANCE))


def block_overlaps(lower: Column, upper: Column, band: tuple[float, float]) -> Column:
    """The same for market blocks: those without a lower edge are channel widths and never meet a band."""
    return (lower <= F.lit(band[1] + TOLERANCE)) & (lower > 0) & (F.coalesce(upper, lower) >= F.lit(band[0] - TOLERANCE))


#: Widths of bins in MHz: the finest, how many times as wide each next one is, and how many there are.
FINEST, STEP, LEVELS = 2.0**-10, 8, 11


def _level(width: Column, finest: float) -> Column:
    """The finest level whose bins are at least an eighth of a width, so that an interval touches nine of them at most."""
    ladder = F.when(width <= finest * STEP, 0)
    for k in range(1, LEVELS - 1):
        ladder = ladder.when(width <= finest * float(STEP) ** (k + 1), k)
    return ladder.otherwise(LEVELS - 1)


def meetings(left: DataFrame, right: DataFrame, a: tuple[str, str], b: tuple[str, str], finest: float = FINEST) -> DataFrame:
    """What overlap_join compares: rows of left and right that share a bin of the wider one's level."""

    def placed(df: DataFrame, lo: str, hi: str, slack: float) -> DataFrame:
        low, high = F.col(lo) - slack, F.col(hi) + slack
        return df.where(F.col(lo) <= F.col(hi)).withColumns({"__lo": low, "__hi": high}).withColumn("__own", _level(F.col("__hi") - F.col("__lo"), finest))

    def dealt(df: DataFrame, levels: Column, name: str) -> DataFrame:
        at = df.withColumn("__level", F.explode(levels))
        width = F.element_at(F.array(*[F.lit(finest * float(STEP) ** k) for k in range(LEVELS)]), F.col("__level") + 1)
        first, last = F.floor(F.col("__lo") / width).cast("long"), F.floor(F.col("__hi") / width).cast("long")
        return at.withColumns({"__bin": F.explode(F.sequence(first, last)), f"__first_{name}": first}).drop("__lo", "__hi", "__own")

    x, y = placed(left, *a, 0.0), placed(right, *b, TOLERANCE)
    found = lambda df: sorted(r["__own"] for r in df.select("__own").distinct().collect())
    on_left, on_right = found(x), found(y)  # a few numbers each
    own = F.array("__own")
    coarser = lambda levels, also: F.filter(F.array(*[F.lit(k) for k in levels]).cast("array<int>"), lambda k: k >= F.col("__own") if also else k > F.col("__own"))
    # The wider side lies at its own level only, the other at each level at which something wider lies.
    sides = ((dealt(x, coarser(on_right, True), "x"), dealt(y, own, "y")), (dealt(x, own, "x"), dealt(y, coarser(on_left, False), "y")))
    parts = [one.join(two, ["__level", "__bin"]) for one, two in sides]
    return parts[0].unionByName(parts[1])


def overlap_join(left: DataFrame, right: DataFrame, a: tuple[str, str], b: tuple[str, str], finest: float = FINEST) -> DataFrame:
    """Rows of left and right whose intervals (low, high columns a and b) meet within half a hertz, each pair once.

    A pair is found in bins of the level of the wider interval, which touches two to nine of them, so most rows of a bin
    that it shares with a narrower one meet it: what is compared is a small multiple of what is found, whatever the widths.
    It is kept in the first bin that both reach. Which levels occur on either side is looked up first. Intervals with a
    null or inverted edge meet nothing. Column names of the sides must differ.
    """
    met = meetings(left, right, a, b, finest).where((F.col(a[0]) <= F.col(b[1]) + TOLERANCE) & (F.col(a[1]) >= F.col(b[0]) - TOLERANCE))
    return met.where(F.col("__bin") == F.greatest("__first_x", "__first_y")).drop("__level", "__bin", "__first_x", "__first_y")


def _swept(rows: DataFrame, asked: DataFrame, sums: list[str], far: Column, parts: int) -> DataFrame:
    """For each asked (id, v): n and sums over the rows whose v is not above its own, and the greatest `far` of them.

    Rows of equal v are added up first. Rows and asked values are then one order over all tasks, dealt by range and written;
    each part's totals, a row a part, are carried into the parts after it, and within a part one window runs over its
    rows. Nothing is paired, so the work grows with rows and asked values, not with what they share.
    """
    from ..sources.scratch import shared_dir

    own = rows.groupBy("v").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in sums], F.max(far).alias("far"))
    names = ["n", *sums, "far"]
    every = own.select("v", F.lit(0).alias("k"), F.lit(None).cast("long").alias("id"), *names).unionByName(asked.select("v", F.lit(1).alias("k"), "id"), allowMissingColumns=True)
    path = f"{shared_dir(rows.sparkSession)}/airledger-sweep/{uuid.uuid4().hex}"
    # A part's number is settled once it is written: ranges of two runs of one plan may differ.
    every.repartitionByRange(parts, "v", "k").withColumn("part", F.spark_partition_id()).write.parquet(path)
    dealt = rows.sparkSession.read.schema(every.withColumn("part", F.lit(0)).schema).parquet(path)
    whole = lambda c: F.max(c) if c == "far" else F.sum(c)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = dealt.groupBy("part").agg(*[whole(c).alias(c) for c in names]).select("part", *[whole(c).over(before).alias(f"{c}_before") for c in names])
    here = Window.partitionBy("part").orderBy("v", "k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = dealt.join(F.broadcast(carried), "part").select("k", "id", *[(whole(c).over(here).alias(c)) for c in names], *[f"{c}_before" for c in names])
    total = lambda c: F.greatest(c, f"{c}_before") if c == "far" else F.coalesce(c, F.lit(0)) + F.coalesce(f"{c}_before", F.lit(0))
    return met.where("k = 1").select("id", *[total(c).alias(c) for c in names])


def occupancy(rows: DataFrame, held: DataFrame, a: tuple[str, str], b: tuple[str, str], sums: list[str], tolerance: float = TOLERANCE) -> DataFrame:
    """held with n, the sum of each of `sums`, lowest and highest over the rows whose interval meets its own.

    Intervals (low, high columns a and b) meet as in overlap_join, but no pair is made. A row that doesn't meet an interval
    either begins above it or ends below it, never both, so what meets is what begins not above it, and what ends not
    below it, less all; the least beginning of what ends not below is that of what meets, if anything does, and so is the
    greatest end. Rows with a null or inverted edge, and null values of `sums`, count for nothing; intervals with such
    edges meet nothing (n 0, null sums). held is given a number for each row; its columns may not be called n, lowest,
    highest, __id or as one of `sums`.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = rows.where(F.col(a[0]) <= F.col(a[1])).select(F.col(a[0]).alias("lo"), F.col(a[1]).alias("hi"), *sums)
    from ..sources.scratch import shared_dir

    path = f"{shared_dir(rows.sparkSession)}/airledger-sweep/{uuid.uuid4().hex}"
    held.withColumn("__id", F.monotonically_increasing_id()).write.parquet(path)
    numbered = rows.sparkSession.read.schema(held.withColumn("__id", F.lit(0).cast("long")).schema).parquet(path)
    asked = numbered.where(F.col(b[0]) <= F.col(b[1]))
    begun = _swept(kept.withColumn("v", F.col("lo")), asked.select(F.col("__id").alias("id"), (F.col(b[1]) + tolerance).alias("v")), sums, F.col("hi"), parts)
    ended = _swept(kept.withColumn("v", -F.col("hi")), asked.select(F.col("__id").alias("id"), (-(F.col(b[0]) - tolerance)).alias("v")), sums, -F.col("lo"), parts)
    every = kept.agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in sums]).first()  # one row of totals
    both = begun.alias("x").join(ended.alias("y"), "id")
    n = (F.col("x.n") + F.col("y.n") - every["n"]).alias("n")
    added = [(F.col(f"x.{c}") + F.col(f"y.{c}") - F.lit(every[c] or 0)).alias(c) for c in sums]
    found = both.select(F.col("id").alias("__id"), n, *added, (-F.col("y.far")).alias("lowest"), F.col("x.far").alias("highest"))
    some = F.col("n") > 0
    out = numbered.join(found, "__id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.select(*held.columns, "n", *[F.when(some, F.col(c)).alias(c) for c in [*sums, "lowest", "highest"]])
