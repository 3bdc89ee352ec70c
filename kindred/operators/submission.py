"""Checks of result files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.sources.tables import split_ids

MATCH_HEADER = ("source1_entity_id", "matched_entity_ids")
CANDIDATE_HEADER = ("source1_entity_id", "candidate_entity_ids")


def _against(rows: DataFrame, spine: DataFrame, name: str) -> DataFrame:
    """Violations of row count and id set, as one row of two counts."""
    sides = rows.select(F.col("source1_entity_id").alias("id"), F.lit(1).alias("a"), F.lit(0).alias("b")).union(spine.select("entity_id", F.lit(0), F.lit(1)))
    ids = sides.groupBy("id").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    return ids.agg(
        F.abs(F.coalesce(F.sum("a"), F.lit(0)) - F.coalesce(F.sum("b"), F.lit(0))).cast("long").alias(f"{name}_row_count"),
        F.count_if((F.col("a") == 0) | (F.col("b") == 0)).alias(f"{name}_ids"),
    )


def validate(matched: DataFrame, candidates: DataFrame, spine: DataFrame) -> DataFrame:
    """(check_name, violations): row counts and id sets of both files against spine (entity_id), whatever their order; lists
    with a repeated id; ids of the first source; ids of no target source (those of the first too); and matches that aren't
    among the candidates of an entity that has a row there."""
    m = matched.select(F.col("source1_entity_id").alias("id"), split_ids(F.col("matched_entity_ids")).alias("l"))
    c = candidates.groupBy("source1_entity_id").agg(F.flatten(F.collect_list(split_ids(F.col("candidate_entity_ids")))).alias("c"))
    lists = m.join(c, m["id"] == c["source1_entity_id"], "left").agg(
        F.count_if(F.size(F.array_distinct("l")) < F.size("l")).alias("repeated_ids"),
        F.coalesce(F.sum(F.size(F.filter("l", lambda x: x.startswith("S1-")))), F.lit(0)).cast("long").alias("first_source_ids"),
        F.coalesce(F.sum(F.size(F.filter("l", lambda x: ~(x.startswith("S2-") | x.startswith("S3-"))))), F.lit(0)).cast("long").alias("foreign_ids"),
        F.coalesce(F.sum(F.when(F.col("c").isNotNull(), F.size(F.array_except("l", "c"))).otherwise(0)), F.lit(0)).cast("long").alias("not_candidates"),
    )
    every = _against(candidates, spine, "candidate").crossJoin(_against(matched, spine, "match")).crossJoin(lists)  # one row each
    return every.select(F.inline(F.array(*(F.struct(F.lit(n).alias("check_name"), F.col(n).alias("violations")) for n in every.columns))))


def summary(matched: DataFrame) -> DataFrame:
    """One row: rows, matches, rows without a match and their share."""
    n = F.size(split_ids(F.col("matched_entity_ids")))
    one = matched.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("total_matches"), F.count_if(n == 0).alias("zero_matches"))
    return one.withColumn("zero_percent", F.round(F.coalesce(F.try_divide(100.0 * F.col("zero_matches"), F.col("rows")), F.lit(0.0)), 6))
