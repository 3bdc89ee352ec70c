"""Exact duplicates by a content sort."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.shared import checkpointed, column, held, released

#: Bytes and rows of one text that a task sorts; a text with more is hot and gets a salt for each such share. Both grow with
#: tables of which more than MOST_HOT texts could be hot.
HOT_BYTES, HOT_ROWS, MOST_HOT = 16 << 20, 500, 500_000
#: A table of hot texts is broadcast up to this number of rows (24 bytes each, and ids).
NEAR = 100_000


def content_sort(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise: Callable[[Column], Column] | None = None,
    keep: str = "min",
    hot_rows: int = HOT_ROWS,
    hot_bytes: int = HOT_BYTES,
) -> DataFrame:
    """Marks all but one of each group of rows with equal text.

    The rows are range-partitioned by the first bytes and a fingerprint of the normalised text, with splitters that Spark
    samples, and sorted on disk by the whole text; the window's neighbouring rows are then compared in full. A hot text, with
    more bytes or rows than a task is to sort (found by sums that are made before they are exchanged), is first dealt to as
    many salted ranges as its size asks for, by id and place; the winners of these ranges are compared once more. So no task
    gets more of one text than that, whatever share of the table it holds, and the table of hot texts has a bounded size.

    Adds keep_id (the id that stays: the smallest or, with keep="max", the largest), group_size and kept, in place of input
    columns of these names; all other columns stay. Null text counts as empty. Null ids lose to any other; of rows with the
    same id and text, any one stays. An empty table gives an empty result.
    """
    assert keep in ("min", "max")
    text = column(text_col)
    norm = F.coalesce((normalise or (lambda x: x))(text), F.lit(""))
    # without a normaliser the text is exchanged once, as what it is compared by, not beside itself in the row
    rows = held(docs, ("keep_id", "group_size", "kept", *([text_col] if normalise is None else [])), id=column(id_col), norm=norm, null=text.isNull())
    rows = rows.withColumns({"head": F.substring("norm", 1, 32), "fp": F.xxhash64("norm")})

    sums = rows.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("norm")).alias("b"))
    n, b = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("norm")), F.lit(0))).first()
    row_limit, byte_limit = max(hot_rows, 2 * n // MOST_HOT), max(hot_bytes, 2 * b // MOST_HOT)
    # one copy of a text can't be split, and a share of more than one row has two at least
    salts = F.least(F.ceil(F.greatest(F.col("n") / row_limit, F.col("b") / byte_limit)), F.ceil(F.col("n") / 2))
    hot = checkpointed(sums.filter((F.col("n") > 1) & ((F.col("n") > row_limit) | (F.col("b") > byte_limit))).select("fp", salts.cast("long").alias("salts")))
    n_hot, all_salts = hot.agg(F.count(F.lit(1)), F.coalesce(F.sum("salts"), F.lit(0))).first()
    order = F.col("id").asc_nulls_last() if keep == "min" else F.col("id").desc_nulls_last()
    best = F.min if keep == "min" else F.max

    # a salt that is the same everywhere would be folded away below the window only, which then asks for another exchange
    by = ["head", "fp", *["salt"] * bool(n_hot)]
    if n_hot:
        rows = rows.join(F.broadcast(hot) if n_hot <= NEAR else hot, "fp", "left")
        rows = rows.withColumn("salt", F.coalesce(F.pmod(F.xxhash64("id", F.spark_partition_id()), F.col("salts")), F.lit(-1).cast("long"))).drop("salts")
    ranged = rows.repartitionByRange(*by)
    same = Window.partitionBy(*by, "norm")
    runs = ranged.withColumns({"rank": F.row_number().over(same.orderBy(order)), "best": best("id").over(same), "size": F.count(F.lit(1)).over(same)})
    if n_hot:
        heads = runs.filter((F.col("salt") >= 0) & (F.col("rank") == 1)).select("norm", "fp", "salt", "best", "size")
        whole = Window.partitionBy("fp", "norm")
        first = F.row_number().over(whole.orderBy(F.col("best").asc_nulls_last() if keep == "min" else F.col("best").desc_nulls_last(), "salt"))
        over = heads.select(F.col("fp").alias("fp2"), F.col("salt").alias("salt2"), F.col("best").alias("run"), best("best").over(whole).alias("all_best"), F.sum("size").over(whole).alias("all_size"), first.alias("place"))
        match = (F.col("fp") == F.col("fp2")) & (F.col("salt") == F.col("salt2")) & F.col("best").eqNullSafe(F.col("run"))
        runs = runs.join(F.broadcast(over) if all_salts <= NEAR else over, match, "left")
        is_hot = F.col("place").isNotNull()
        keep_id, size, won = F.when(is_hot, F.col("all_best")).otherwise(F.col("best")), F.coalesce("all_size", "size"), F.coalesce(F.col("place") == 1, F.lit(True))
    else:
        keep_id, size, won = F.col("best"), F.col("size"), F.lit(True)
    made = {"keep_id": keep_id, "group_size": size, "kept": (F.col("rank") == 1) & won}
    if normalise is not None:
        return released(runs, docs, (), **made)
    out = released(runs, docs, [text_col], **{text_col: F.when(~F.col("null"), F.col("norm"))}, **made)
    return out.select(*(column(c) for c in docs.columns if c.lower() not in made), *made)
