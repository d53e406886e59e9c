"""Mixing of sources to target weights, by weighted sampling without replacement and whole epochs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.operators.joins import lookup_join
from recordloom.session import stage

#: Hex digits of a digest that make a document's random number, and how many numbers they tell apart.
DIGITS, NUMBERS = 13, 16**13
LEAST_QUALITY = 0.05
#: Fixed: characters that lower a text's quality.
NO_PROSE = "0123456789!#$%&'()*+,-./:;<=>?@[]^_`{|}~"


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def text_quality(text: Column) -> Column:
    """The share of characters that are neither digits nor marks, ``LEAST_QUALITY`` at least."""
    text = F.coalesce(text, F.lit(""))
    share = F.length(F.translate(text, NO_PROSE, "")) / F.greatest(F.length(text), F.lit(1))
    return F.greatest(share, F.lit(LEAST_QUALITY))


def targets(sources: DataFrame, weights: int, most: int) -> DataFrame:
    """``source, source_size, n, target, budget`` of ``source, source_size, n``.

    Sources by code point, the null one last, weigh 1 to ``weights``, repeating, and share the sum of
    all sizes. None gets more than ``most`` times its size; the excess goes to the others by
    weight. Ordered by the share at which they are full, the full ones come first, so two running sums
    give the level of all others at once.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    ranked = sources.withColumn("weight", ((rank - 1) % weights + 1).cast("long")).withColumn("cap", most * F.col("source_size"))
    by_fullness = [F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()]
    before = Window.orderBy(*by_fullness).rowsBetween(Window.unboundedPreceding, -1)
    onwards = Window.orderBy(*by_fullness).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).orderBy(*by_fullness)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    level = ranked.withColumn("level", left.cast("double") / F.sum("weight").over(onwards))
    is_open = F.col("weight") * F.col("level") < F.col("cap")
    level = level.withColumn("level", F.first(F.when(is_open, F.col("level")), ignorenulls=True).over(everything))
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("weight") * F.col("level"), F.col("cap").cast("double")))
    return level.withColumn("target", target).withColumn("budget", F.round("target").cast("long")).select("source", "source_size", "n", "target", "budget")


def mix(df: DataFrame, key: str, text: str, source: str, weights: int = 3, most: int = 3) -> DataFrame:
    """``key, size, source_size, target, taken`` of every row: how many of its words the mix takes.

    ``size`` counts words. A source takes as many whole epochs of itself as its target holds; the rest
    of its budget goes to documents in the order of exponential keys, divided by the quality of their text, smallest first
    (a weighted sample without replacement). The last one is cut, so a source takes its target, rounded.

    The random number of a document comes of a digest of key and text, so reruns agree. Rows
    equal in both follow each other and have equal sizes, so it does not matter which of them comes first. Null texts and
    texts without words have size 0 and take nothing; a null source is a source, a null key a key. An
    empty table gives no rows.

    Running sums need no source in one task: rows are counted by slices of the logarithm of their keys, of
    which a source has in the order of the square root of its rows, and so many rows lie in one slice at most,
    whatever the qualities. Only the slice in which the budget runs out is sorted by row.
    """
    what = df[text].cast("string")
    digest = F.md5(F.concat(F.coalesce(df[key].cast("string"), F.lit("")), F.lit(":"), F.coalesce(what, F.lit(""))).cast("binary"))
    number = (F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("double") + F.lit(1.0)) / F.lit(float(NUMBERS + 1))
    rows = stage(df.select(
        df[key].alias("key"), df[source].cast("string").alias("source"), words_in(what).alias("size"), (-F.log(number) / text_quality(what)).alias("order"),
    ), "sizes")
    per_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    # a null source joins by this name too
    named = lambda frame: frame.withColumn("_source", F.concat(F.when(F.col("source").isNull(), "-").otherwise("+"), F.coalesce("source", F.lit(""))))
    goals = stage(named(targets(per_source, weights, most)).drop("source"), "targets")
    epochs = F.expr("CASE WHEN source_size > 0 THEN budget DIV source_size ELSE 0 END")
    goals = goals.withColumn("epochs", epochs).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size"))
    slices = F.floor(F.log("order") * F.ceil(F.sqrt("n"))).cast("long")
    dealt = lookup_join(named(rows), goals, "_source", "inner").withColumn("slice", slices)
    counted = dealt.groupBy("_source", "slice").agg(F.sum("size").alias("slice_size"), F.first("rest").alias("rest"))
    earlier = Window.partitionBy("_source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.withColumn("before", F.coalesce(F.sum("slice_size").over(earlier), F.lit(0)))
    cuts = counted.where("before <= rest and before + slice_size > rest").select("_source", F.col("slice").alias("cut"), "before")
    cuts = stage(cuts, "cuts")
    placed = lookup_join(dealt, cuts, "_source", "left")
    columns = ["key", "size", "source_size", "target"]
    whole = F.col("epochs") * F.col("size")
    clear = placed.where("cut is null or slice <> cut").select(
        *columns, (whole + F.when(F.col("cut").isNull() | (F.col("slice") > F.col("cut")), 0).otherwise(F.col("size"))).alias("taken")
    )
    running = Window.partitionBy("_source").orderBy("order", "key", "size").rowsBetween(Window.unboundedPreceding, -1)
    last = placed.where("slice = cut").withColumn("left", F.col("rest") - F.col("before") - F.coalesce(F.sum("size").over(running), F.lit(0)))
    last = last.select(*columns, (whole + F.greatest(F.lit(0), F.least("left", "size"))).alias("taken"))
    return clear.unionByName(last).withColumnRenamed("key", key)
