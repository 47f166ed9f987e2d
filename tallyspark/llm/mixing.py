"""Mixing sources to target weights, with DataFrame functions only.

Targets come from water-filling: every source gets its share by weight, none more
than ``max_epochs`` times its size, and what is cut off goes to the others.  A
source's target is met by complete epochs first; the rest is drawn without
replacement by Efraimidis-Spirakis keys, sorted within the source and prefix-summed
up to the budget.  The prefix sum runs over ranges of the key that hold about equally many
rows, whatever the weights, so a source that holds most rows is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import settle, word_count

#: Key ranges of a source for each million of its rows, and at least so many.
RANGES_PER_MILLION, LEAST_RANGES = 64, 64
#: Steps of the key, from one power of two to the next, that ranges are put together from.
STEPS = 128


def quality_weight(text: Column) -> Column:
    """1 for plain prose down to 0.1 for text made of symbols; 1 for empty or null text."""
    size = F.length(text)
    noise = size - F.length(F.regexp_replace(text, r"[#$%&*|<>{}\[\]=~^\\!]+", ""))
    return F.when(size > 0, F.greatest(F.lit(0.1), 1.0 - 4.0 * noise / size)).otherwise(F.lit(1.0))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), max_epochs: int = 3) -> DataFrame:
    """``source, size`` (one row a source) -> ``source, source_size, target``.

    Sources by code point, null last, weigh ``weights`` in turn.  The level of the
    water is found in closed form: with sources sorted by the level at which they are full,
    the level if all before a source are full rises up to the first source that isn't full
    at it, and falls from there.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1)
    full = F.col("source_size") * F.lit(float(max_epochs))
    level_when_full = full / F.col("weight")
    ranked = sizes.select("source", F.col("size").alias("source_size")).withColumn("weight", weight)
    before = Window.orderBy(level_when_full, F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = (
        ranked.withColumn("full", full)
        .withColumn("level_when_full", level_when_full)
        .withColumn("full_before", F.coalesce(F.sum("full").over(before), F.lit(0.0)))
        .withColumn("weight_before", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("total", F.sum("source_size").over(whole).cast("double"))
        .withColumn("total_weight", F.sum("weight").over(whole))
        .withColumn("level", (F.col("total") - F.col("full_before")) / (F.col("total_weight") - F.col("weight_before")))
        .withColumn("level", F.max(F.when(F.col("level") <= F.col("level_when_full"), F.col("level"))).over(whole))
    )
    target = F.least(F.col("full"), F.coalesce(F.col("level"), F.lit(0.0)) * F.col("weight"))
    return ranked.select("source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (1.0, 2.0, 3.0),
    max_epochs: int = 3,
    seed: int = 11,
) -> DataFrame:
    """``doc_id, text, source`` -> ``doc_id, source, size, source_size, target, taken, copies``.

    ``taken`` is the number of words the mix takes of a document: ``copies`` times its
    size.  After the prefix of the draw, one more document a source may enter: the one
    whose size is nearest to what is still missing, if that brings the source nearer.

    Null or empty text: size 0, taken 0.  A null source is a source of its own.  Rows without
    an id are drawn by their text.  Repeated rows are separate documents that share a key, so
    a task holds those of one key; an empty table gives an empty result.  Texts of any length
    are counted whole.  Other columns are ignored, whatever their names.
    """
    unnamed = F.when(F.col("doc_id").isNull(), F.xxhash64("text"))
    named = docs.select("doc_id", "source", unnamed.alias("unnamed"), word_count(F.col("text")).alias("size"), quality_weight(F.col("text")).alias("weight"))
    # A uniform number from the id: (0, 1), the same in every run.
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "source", "unnamed"), 11) + 0.5) / float(1 << 53)
    # The exponential key; the draw takes the smallest first.
    key = F.greatest(-F.log(uniform) / F.col("weight"), F.lit(1e-300))
    step = F.floor(F.log2(F.col("key")) * STEPS).cast("int")
    sized = settle(named.withColumn("key", key).withColumn("step", step).drop("weight", "unnamed"), "mix-sizes")

    totals = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("rows"))
    sources = source_targets(totals, weights, max_epochs).join(totals.select(F.col("source").alias("s"), "rows"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    sources = (
        sources.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
        .withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size"))
        .withColumn("ranges", F.greatest(F.lit(LEAST_RANGES), F.ceil(F.col("rows") * (RANGES_PER_MILLION / 1e6))))
    )
    sources = settle(sources.drop("rows"), "mix-sources").withColumnRenamed("source", "s")
    same = F.col("source").eqNullSafe(F.col("s"))

    # A step holds two in a thousand of a source's rows at most; steps merge into ranges of equal rows.
    steps = sized.groupBy("source", "step").agg(F.count("*").alias("rows"))
    upto = Window.partitionBy("source").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    of_source = Window.partitionBy("source")
    behind = F.coalesce(F.sum("rows").over(upto), F.lit(0)) / F.sum("rows").over(of_source)
    steps = steps.withColumn("behind", behind).join(sources.select("s", "ranges"), same)
    steps = settle(steps.select(F.col("source").alias("s"), F.col("step").alias("t"), F.floor(F.col("behind") * F.col("ranges")).alias("range")), "mix-ranges")

    drawn = sized.join(sources.drop("ranges"), same).drop("s")
    drawn = drawn.join(steps, same & (F.col("step") == F.col("t"))).drop("s", "t")
    # Words before each range, from sums of ranges; then the words before a document inside its range.
    by_range = drawn.groupBy("source", "range").agg(F.sum("size").alias("in_range"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_range.select(
        F.col("source").alias("s"), F.col("range").alias("r"), F.coalesce(F.sum("in_range").over(before), F.lit(0)).alias("range_start")
    )
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    drawn = drawn.join(starts, same & (F.col("range") == F.col("r"))).drop("s", "r")
    words_before = F.col("range_start") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    drawn = drawn.withColumn("chosen", words_before + F.col("size") <= F.col("budget"))
    drawn = settle(drawn.select("doc_id", "source", "size", "source_size", "target", "epochs", "budget", "key", "chosen"), "mix-drawn")

    # What the prefix leaves open, closed by the nearest size.
    gaps = drawn.groupBy("source").agg((F.first("budget") - F.sum(F.when(F.col("chosen"), F.col("size")).otherwise(0))).alias("gap"))
    # Written, so that Spark knows the size of these tables of one row a source and needn't deal the documents out by source.
    gaps = settle(gaps, "mix-gaps").withColumnRenamed("source", "s")
    off = F.abs(F.col("size") - F.col("gap"))
    rest = drawn.filter(~F.col("chosen") & (F.col("size") > 0)).join(gaps, same)
    nearest = F.struct(off.alias("off"), F.col("key").alias("k"), F.col("doc_id").alias("d"), F.col("size").alias("n"), F.col("gap").alias("g"))
    closing = (
        rest.groupBy("source")
        .agg(F.min(nearest).alias("best"))
        .filter(F.col("best.off") < F.abs(F.col("best.g")))
        .select("source", F.col("best.d").alias("closing_id"), F.col("best.n").alias("closing_size"))
    )
    closing = settle(closing, "mix-closing").withColumnRenamed("source", "s")
    out = drawn.join(closing, same, "left").drop("s")
    # Rows that repeat a doc_id and its size in one source close at most once.
    closes = ~F.col("chosen") & F.col("doc_id").eqNullSafe(F.col("closing_id")) & F.coalesce(F.col("size") == F.col("closing_size"), F.lit(False))
    out = out.withColumn("closes", closes)
    once = F.row_number().over(Window.partitionBy("source", "doc_id", "closes").orderBy("key"))
    closed = out.filter("closes").withColumn("first", once == 1)
    plain = out.filter("not closes").withColumn("first", F.lit(False))
    copies = F.col("epochs") + F.when(F.col("chosen") | F.col("first"), 1).otherwise(0)
    return plain.unionByName(closed).select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        (F.col("size") * copies).cast("long").alias("taken"),
        copies.cast("int").alias("copies"),
    )
