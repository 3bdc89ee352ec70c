"""Sharding by a histogram sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.shared import checkpointed, column, held, md5_key, released

#: Bits of a sort key, and bits that one round of probes resolves.
BITS, STEP = 60, 12
#: Bytes that one task of the exchange is to get, about; a shard has several such tasks.
TASK_BYTES = 32 << 20


def below(splitters: list[int], key: Column) -> Column:
    """How many splitters (in rising order) are at most key: a binary search of nested conditions."""

    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key < splitters[mid], search(lo, mid)).otherwise(search(mid + 1, hi))

    return search(0, len(splitters))


def find_splitters(slim: DataFrame, shards: int, tolerance: float) -> tuple[list[int], int]:
    """Splitters of (key, size) rows: splitter k is the least key with at least k / shards of all bytes below it, or any key
    that misses that by tolerance * (bytes of a shard) at most. Each round probes 4,096 boundaries within each open interval
    and counts the exact bytes below them; a round sends at most shards * 4,096 sums to the driver. Returns the total too."""
    total = slim.agg(F.sum("size")).first()[0] or 0
    open_ = {k: (0, 0) for k in range(1, shards)}  # splitter: prefix of its interval, bytes below that
    found: dict[int, int] = {}
    for done in range(STEP, BITS + 1, STEP):
        prefixes = sorted({p for p, _ in open_.values()})
        if not prefixes or not total:
            break
        inside = slim if done == STEP else slim.filter(F.shiftright("key", BITS - done + STEP).isin(prefixes))
        bars: dict[int, list[tuple[int, int]]] = {}
        for bar, size in inside.groupBy(F.shiftright("key", BITS - done).alias("bar")).agg(F.sum("size")).collect():
            bars.setdefault(bar >> STEP, []).append((bar, size))
        for k, (prefix, base) in list(open_.items()):
            # at least k / shards of all bytes are below the splitter, so it comes after the bar that reaches them
            for bar, size in sorted(bars.get(prefix, [])):
                over = (base + size) * shards - k * total
                if over >= 0:
                    if done == BITS or over <= tolerance * total:
                        found[k] = (bar + 1) << (BITS - done)
                        del open_[k]
                    else:
                        open_[k] = (bar, base)
                    break
                base += size
    return [found.get(k, 1 << BITS) for k in range(1, shards)], total


def shard(
    docs: DataFrame, shards: int = 16, id_col: str = "doc_id", key: Column | None = None, size: Column | None = None, tolerance: float = 0.0, task_bytes: int = TASK_BYTES
) -> DataFrame:
    """Puts rows into shards of nearly equal bytes and numbers them within each shard.

    The sort key is 60 bits of the id's md5 (or a given long column of 60 bits), so shards are also shuffled samples. The
    bytes below probes are counted exactly, and probes are refined until each splitter meets the tolerance (0: until it is a
    single key). Then whole rows are exchanged once, by shard and a part of the key's range, to as many tasks as their bytes
    ask for; a part's rows are sorted, and the counts of the parts before it give its first slot. No task gets a whole shard.

    Adds size, law ('bytes'), shard and slot in place of input columns of these names. Sizes are UTF-8 bytes of text (null:
    none) plus 1. Rows with the same id have the same key and stay in one shard; null ids count as one id. A row too large
    for one share leaves the next shards empty. An empty table gives an empty result.
    """
    assert shards >= 1
    own = size if size is not None else F.octet_length(F.coalesce(F.col("text"), F.lit(""))) + 1
    place_of = key if key is not None else md5_key(column(id_col), BITS // 4)
    rows = held(docs, ("size", "law", "shard", "slot"), id=column(id_col), size=own.cast("long"), key=place_of)
    slim = checkpointed(rows.select("key", "size"))
    splitters, total = find_splitters(slim, shards, tolerance)
    bits = min(20, max(8, (max(1, total) // task_bytes).bit_length() + 2))
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // task_bytes))

    def place(df: DataFrame) -> DataFrame:
        return df.withColumns({"shard": below(splitters, F.col("key")), "part": F.shiftright("key", BITS - bits)})

    parts = place(slim).groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("shard", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "part").orderBy("key", "id")
    made = place(rows).repartition(tasks, "shard", "part").withColumn("n", F.row_number().over(within))
    # a row for each part and one more for each splitter: 2^20 + shards at most
    made = made.join(F.broadcast(starts), ["shard", "part"])
    return released(made, docs, (), size=F.col("size"), law=F.lit("bytes"), shard=F.col("shard"), slot=(F.col("start") + F.col("n") - 1).cast("long"))
