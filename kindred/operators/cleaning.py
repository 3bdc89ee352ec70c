"""Cleaned tables, and checks that cleaning kept what it should."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.functions import normalize as N

ORIGINAL = ("business_name", "business_address", "country")
ADDED = ("business_name_clean", "business_address_clean", "country_clean", "name_tokens", "name_length", "address_length")


def clean_table(rows: DataFrame) -> DataFrame:
    """Adds the six derived columns; the given ones stay as they are. Lengths are code points of the cleaned texts. One
    projection: nothing is exchanged."""
    made = rows.withColumns(
        {
            "business_name_clean": N.normalize_name(F.col("business_name")),
            "business_address_clean": N.normalize_address(F.col("business_address")),
            "country_clean": N.normalize_country(F.col("country")),
        }
    )
    return made.withColumns({"name_tokens": N.tokens(F.col("business_name_clean")), "name_length": F.length("business_name_clean"), "address_length": F.length("business_address_clean")})


def profile(rows: DataFrame, key: str = "entity_id") -> DataFrame:
    """(column_name, rows, nulls, null_percent) for each column, in one aggregate; and duplicates of the key for all."""
    named = [c for c in rows.columns if c != "ord"]
    one = rows.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col(c).isNull()).alias(f"c{i}") for i, c in enumerate(named)))
    listed = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"c{i}").alias("nulls")) for i, c in enumerate(named)))
    flat = one.select("n", F.inline(listed))
    return flat.select("column_name", F.col("n").alias("rows"), "nulls", F.round(F.coalesce(F.try_divide(100.0 * F.col("nulls"), F.col("n")), F.lit(0.0)), 6).alias("null_percent"))


def duplicate_keys(rows: DataFrame, key: str = "entity_id") -> DataFrame:
    """(rows, distinct_keys, duplicates): null counts as one more key."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("distinct_keys")).withColumn("duplicates", F.col("rows") - F.col("distinct_keys"))


def top_countries(rows: DataFrame, n: int = 5) -> DataFrame:
    """The n most frequent countries, null among them; ties by name, null last."""
    return rows.groupBy("country").agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), F.col("country").asc_nulls_last()).limit(n)


def shape(rows: DataFrame) -> DataFrame:
    """(rows, columns, names): one row; names are in order, separated by commas."""
    named = [c for c in rows.columns if c != "ord"]
    return rows.agg(F.count(F.lit(1)).alias("rows")).withColumns({"columns": F.lit(len(named)).cast("long"), "names": F.lit(",".join(named))})


def first_rows(rows: DataFrame, n: int = 3) -> DataFrame:
    """The first n rows in file order."""
    return rows.orderBy("ord").limit(n)


def inspect(rows: DataFrame) -> dict:
    """Shape, missing values by column, repeated ids, most frequent countries and first rows of one table. Ids and countries
    are looked at where the table has them."""
    key = next((c for c in ("entity_id", "source1_entity_id") if c in rows.columns), None)
    size = shape(rows).first()
    return {
        "rows": size["rows"],
        "columns": size["names"].split(",") if size["names"] else [],
        "missing": {r.column_name: [r.nulls, r.null_percent] for r in profile(rows).collect()},
        "repeated_ids": duplicate_keys(rows, key).first()["duplicates"] if key else None,
        "top_countries": [[r.country, r["rows"]] for r in top_countries(rows).collect()] if "country" in rows.columns else None,
        "first_rows": [[r[c] for c in rows.columns if c != "ord"] for r in first_rows(rows).collect()],
    }


def inspect_all(tables: dict[str, DataFrame]) -> dict[str, dict]:
    """inspect() of every table."""
    return {name: inspect(rows) for name, rows in tables.items()}


def check_clean(before: DataFrame, after: DataFrame) -> DataFrame:
    """(check_name, violations): row count, ids by ord, unchanged originals (null and '' are alike), added columns, countries."""
    lacking = [c for c in ADDED if c not in after.columns]
    a = before.select("ord", F.struct("entity_id", *ORIGINAL).alias("a"))
    b = after.select("ord", F.struct("entity_id", *ORIGINAL).alias("b"))
    joined = a.join(b, "ord", "full_outer")
    same = [F.coalesce(F.col(f"a.{c}"), F.lit("")).eqNullSafe(F.coalesce(F.col(f"b.{c}"), F.lit(""))) for c in ORIGINAL]
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    counted = joined.agg(
        F.abs(F.count("a") - F.count("b")).alias("row_count"),
        F.count_if(~F.col("a.entity_id").eqNullSafe(F.col("b.entity_id"))).alias("entity_ids"),
        *(F.count_if(both & ~s).alias(c) for c, s in zip(ORIGINAL, same, strict=True)),
    )
    sides = before.select("country", F.lit(1).alias("a"), F.lit(0).alias("b")).union(after.select("country", F.lit(0), F.lit(1)))
    countries = sides.filter("country is not null").groupBy("country").agg(F.max("a").alias("a"), F.max("b").alias("b")).agg(F.count_if(F.col("a") != F.col("b")).alias("countries"))
    names = ["row_count", "entity_ids", *ORIGINAL, "countries"]
    every = counted.crossJoin(countries).withColumn("added_columns", F.lit(len(lacking)).cast("long"))  # one row each
    return every.select(F.inline(F.array(*(F.struct(F.lit(n).alias("check_name"), F.col(n).cast("long").alias("violations")) for n in [*names, "added_columns"]))))
