"""Mixing sources to target weights along a time-varying curriculum.

Sources get weights 5, 2, 1, 5, ... in code point order (null last) and share 150 % of all
words; a target stops at twice its source's size and the excess is shared again by weight
(the water level at which the targets add up, found in closed form). Within a source,
documents stand in a fixed pseudo-random order and their words fill the target once or
twice: a document takes what the target covers of its stretch of words, so the words
taken add up to the target's whole part.

Each weight class has a schedule, its relative weight over training time, linear between
knots. The integral of the schedule is the source's cumulative demand; inverting it at a
document's stretch gives the time at which the document is read, and rows are range-sorted
by that time (``position``; ``position_2`` is its second reading).

Sums of words before a document are built in two levels (buckets of the order, then
documents of a bucket), so a source that holds a third of all rows is spread over
``BUCKETS`` groups. A null or blank text has size 0 and takes nothing, equal rows stand
side by side and split what they get, null ids are ordered before others, an empty table
gives an empty result. In :func:`mix` the added columns replace columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEIGHTS = (5, 2, 1)
BUCKETS = 4096
WORD = r"[^\x20\x09-\x0D]+"
#: Relative weight of each class at the start, at each equal step and at the end of training.
SCHEDULES = ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5))
ADDED = ("size", "source_size", "target", "taken", "position", "position_2")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame) -> DataFrame:
    """(_source, _class, source_size, target) from one row per source; the weights' water level in closed form."""
    every = Window.orderBy(F.col("_source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), F.col("_class") + 1)
    ranked = sizes.withColumn("_class", ((F.row_number().over(every) - 1) % len(WEIGHTS)).cast("int")).withColumn("_w", weight)
    # sources by the level at which they are full; below it a source gets its weight times the level
    full = Window.orderBy(F.col("source_size") / F.col("_w"), "_source")
    lower, rest, whole = full.rowsBetween(Window.unboundedPreceding, -1), full.rowsBetween(0, Window.unboundedFollowing), full.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (3 * F.sum("source_size").over(whole) - 4 * F.coalesce(F.sum("source_size").over(lower), F.lit(0))) / (2 * F.sum("_w").over(rest))
    levels = ranked.withColumn("_level", level).withColumn("_fits", F.col("_level") * F.col("_w") <= 2 * F.col("source_size"))
    # the first source in that order that is not full by its level sets it
    first = F.min(F.when(F.col("_fits"), F.struct((F.col("source_size") / F.col("_w")).alias("_at"), F.col("_level")))).over(whole)
    water = F.coalesce(first["_level"], F.lit(float("inf")))
    return levels.withColumn("_water", water).select("_source", "_class", "source_size", F.least(2.0 * F.col("source_size"), F.col("_w") * F.col("_water")).alias("target"))


def time_of(share: Column, knots: tuple[float, ...]) -> Column:
    """The time by which a schedule has asked for a share of its demand."""
    step = 1.0 / (len(knots) - 1)
    areas = [step * (a + b) / 2 for a, b in zip(knots, knots[1:], strict=False)]
    need, done, out = share * F.lit(sum(areas)), 0.0, None
    for k, (a, b, area) in enumerate(zip(knots, knots[1:], areas, strict=False)):
        left = F.greatest(F.lit(0.0), need - F.lit(done))
        slope = (b - a) / step
        # a t + slope t^2 / 2 = left, in the form that is stable for any slope
        root = F.coalesce(F.try_divide(2.0 * left, F.lit(a) + F.sqrt(F.greatest(F.lit(0.0), F.lit(a * a) + 2.0 * slope * left))), F.lit(0.0))
        at = F.lit(k * step) + F.least(F.lit(step), root)
        done += area
        out = F.when(need <= F.lit(done), at) if out is None else out.when(need <= F.lit(done), at) if k < len(areas) - 1 else out.otherwise(at)
    return F.coalesce(out if len(areas) > 1 else at, F.lit(0.0))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """All rows and columns with ``ADDED``, range-sorted by position, rows that are not taken last."""
    kept = [c for c in docs.columns if c not in ADDED]
    order = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), F.col(id_col).cast("string").alias("_id"), F.col(source_col).alias("_source"), word_count(F.col(text_col)).alias("size"), order.alias("_order")
    ).withColumns({
        "_key": F.when(F.col("_source").isNull(), "null").otherwise(F.concat(F.lit("="), "_source")),
        "_bucket": (F.conv(F.substring("_order", 1, 8), 16, 10).cast("bigint") % BUCKETS).cast("int"),
    })
    by_bucket = rows.groupBy("_key", "_source", "_bucket").agg(F.sum("size").alias("_in_bucket"))
    by_source = targets(by_bucket.groupBy("_key", "_source").agg(F.sum("_in_bucket").alias("source_size"))).withColumn("_key", F.when(F.col("_source").isNull(), "null").otherwise(F.concat(F.lit("="), "_source")))
    earlier = Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_bucket.withColumn("_before", F.coalesce(F.sum("_in_bucket").over(earlier), F.lit(0))).select("_key", "_bucket", "_before").join(by_source.drop("_source"), "_key")
    within = Window.partitionBy("_key", "_bucket").orderBy("_order", "_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_inside", F.coalesce(F.sum("size").over(within), F.lit(0))).join(starts, ["_key", "_bucket"])
    at, whole, size = F.col("_before") + F.col("_inside"), F.floor("target"), F.col("size")
    rounds = F.when(F.col("source_size") > 0, F.floor(whole / F.col("source_size"))).otherwise(F.lit(0))
    taken = rounds * size + F.greatest(F.lit(0), F.least(size, whole - rounds * F.col("source_size") - at))
    out = placed.withColumns({"taken": taken.cast("bigint"), "_at": at})

    def position(reading: int) -> Column:
        share = (F.col("_at") + F.lit(reading) * F.col("source_size")) / F.col("target")
        times = [time_of(share, knots) for knots in SCHEDULES]
        by_class = F.when(F.col("_class") == 0, times[0]).when(F.col("_class") == 1, times[1]).otherwise(times[2])
        # read for the given time where the target reaches the document's stretch that often
        return F.when((F.col("taken") > 0) & (share < 1) & (size > 0), by_class)

    out = out.withColumns({"position": position(0), "position_2": position(1)})
    return out.orderBy(F.col("position").asc_nulls_last(), "_order").select("_row.*", *ADDED)
