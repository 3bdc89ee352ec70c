"""Mixing sources to target weights by hash thresholds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.shared import checkpointed, column, held, md5_key, released, word_count

#: Hash bits, and bits that one histogram resolves.
BITS, STEP = 48, 12
#: A table with a row for each source is broadcast up to this number of sources.
FEW_SOURCES = 100_000


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Targets of sources (source, source_size): weights in order of code points, repeated, null last. share of all sizes is
    dealt by weight; no target is above most times its source's size, and what is over goes to the others by weight.

    With r = cap / weight in rising order, a source is capped while (rest of the budget) / (weights from here on) is above
    its r; the first share below its r holds for all sources that aren't capped. One row for each source is all it handles."""
    listed = F.array(*(F.lit(float(w)) for w in weights))
    ranked = sizes.withColumn("__rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumn("weight", F.element_at(listed, ((F.col("__rank") - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumns({"__cap": F.col("source_size") * F.lit(float(most)), "__r": F.col("source_size") * F.lit(float(most)) / F.col("weight")})
    rising = Window.orderBy("__r", "__rank")
    before, after = rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    budget = F.lit(float(share)) * F.sum("source_size").over(everything)
    ranked = ranked.withColumn("__level", (budget - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    level = F.max(F.when(F.col("__level") <= F.col("__r"), F.col("__level"))).over(everything)
    return ranked.withColumn("target", F.least(F.col("__cap"), level * F.col("weight"))).select("source", "source_size", "weight", "target")


def mix(
    docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: int = 2, id_col: str = "doc_id", source_col: str = "source", size: Column | None = None
) -> DataFrame:
    """Says how many words of each document a mix takes.

    A document's md5 gives it a place on a line of 2^48; a source takes all its documents floor(target / size) times, and
    those below a threshold once more. The threshold comes from nested histograms: sums of sizes by source and 4,096
    buckets, then again only within the bucket where the budget ends, until a bucket is one hash value, which is taken if
    that ends nearer the target. Nothing is sorted; each histogram is summed before it is exchanged. Reruns and other
    partitionings give the same mix. Rows with the same id share their place and are taken together.

    Adds size, source_size, target and taken (in place of input columns of these names). Null text has size 0; null is a
    source of its own, and is last. An empty table gives an empty result.
    """
    own, source = (size if size is not None else word_count(F.col("text"))), column(source_col)
    key = F.coalesce(F.concat(F.lit("="), source), F.lit("null"))
    rows = held(docs, ("size", "source_size", "target", "taken"), size=own, key=key, hash=md5_key(column(id_col), BITS // 4), source=source)
    slim = checkpointed(rows.select("key", "hash", "size", "source"))

    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    few = slim.agg(F.approx_count_distinct("key")).first()[0] <= FEW_SOURCES // 2
    near = F.broadcast if few else (lambda x: x)
    targets = source_targets(sizes, weights, share, most).withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    targets = targets.withColumn("times", whole.cast("long")).withColumn("rest", F.col("target") - F.col("times") * F.col("source_size"))

    # open: where the budget ends so far, as (key, prefix of the hash, words below it, budget)
    open_ = targets.select("key", F.lit(0).cast("long").alias("prefix"), F.lit(0.0).alias("below"), "rest")
    for done in range(STEP, BITS + 1, STEP):
        inner = slim.select("key", F.shiftright("hash", BITS - done).alias("bucket"), F.shiftright("hash", BITS - done + STEP).alias("prefix"), "size")
        bars = inner.join(near(open_), ["key", "prefix"]).groupBy("key", "bucket", "below", "rest").agg(F.sum("size").alias("words"))
        upto = Window.partitionBy("key").orderBy("bucket")
        bars = bars.withColumn("end", F.col("below") + F.sum("words").over(upto))
        over = bars.filter(F.col("end") > F.col("rest")).groupBy("key").agg(F.min_by(F.struct("bucket", "words", "end", "rest"), "bucket").alias("b"))
        open_ = over.select("key", F.col("b.bucket").alias("prefix"), (F.col("b.end") - F.col("b.words")).alias("below"), F.col("b.rest").alias("rest"), F.col("b.end").alias("end"))
    nearer = F.col("end") - F.col("rest") <= F.col("rest") - F.col("below")
    ends = open_.select("key", F.when(nearer, F.col("prefix") + 1).otherwise(F.col("prefix")).alias("threshold"))
    plan = targets.join(near(ends), "key", "left").select("key", "source_size", "target", "times", F.coalesce("threshold", F.lit(0)).alias("threshold"))
    again = F.when(F.col("hash") < F.col("threshold"), F.lit(1)).otherwise(F.lit(0))
    made = {"size": F.col("size"), "source_size": F.col("source_size"), "target": F.col("target"), "taken": (F.col("size") * (F.col("times") + again)).cast("long")}
    return released(rows.join(near(plan), "key"), docs, (), **made)
