import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from kindred.llm.sharding import below, shard
from tests.conftest import SMALL


def brute(rows, shards):
    """(id, size, shard, slot), sorted by the md5 of the id."""
    keyed = sorted((int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:15], 16), i or 0, i, len((t or "").encode()) + 1) for i, t in rows)
    total, sizes = sum(k[3] for k in keyed), {}
    for key, _, _, size in keyed:
        sizes[key] = sizes.get(key, 0) + size
    start, at = {}, 0
    for key, size in sizes.items():
        start[key] = at
        at += size
    out, slots = [], {}
    for key, _, i, size in keyed:
        s = start[key] * shards // total
        out.append((i, size, s, slots.setdefault(s, 0)))
        slots[s] += 1
    return out


def test_query(spark):
    from kindred.llm.queries import op9_histogram_sort

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = op9_histogram_sort(spark, SMALL).collect()
    assert sorted((r.doc_id, r.size, r.shard, r.slot) for r in got) == sorted(brute(rows, 16))
    text = dict(rows)
    assert all(r.text_crc32 == zlib.crc32((text[r.doc_id] or "").encode()) and r.law == "bytes" and r.grown_shard is None for r in got)


@pytest.mark.parametrize("shards", [1, 2, 5])
def test_odd_rows(spark, shards):
    rows = [(i, "é" * (i % 7)) for i in range(200)] + [(None, None), (None, "x"), (5, "again"), (1000, "y" * 50_000)]
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, shard string").repartition(3)
    got = shard(docs, shards, task_bytes=1000).collect()
    assert sorted((str(r.doc_id), r.size, r.shard) for r in got) == sorted((str(i), s, k) for i, s, k, _ in brute(rows, shards))
    for k in range(shards):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))
    assert shard(docs.limit(0), shards).collect() == []


def test_even_bytes(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("a"), (F.col("id") % 100).cast("int")).alias("text"))
    for tolerance in (0.0, 0.01):
        sizes = [r["sum(size)"] for r in shard(docs, 16, tolerance=tolerance).groupBy("shard").sum("size").collect()]
        assert len(sizes) == 16 and max(sizes) - min(sizes) <= 200 + 2 * tolerance * sum(sizes) / 16


def test_below(spark):
    cuts = [3, 5, 5, 9]
    rows = spark.range(12).select("id", below(cuts, F.col("id")).alias("n")).collect()
    assert all(r.n == sum(c <= r.id for c in cuts) for r in rows)


def test_names(spark):
    docs = spark.createDataFrame([(1, "a", 2, 3, 4)], "doc_id long, text string, __mine int, `a.b` int, SLOT int")
    assert shard(docs, 2).columns == ["doc_id", "text", "__mine", "a.b", "size", "law", "shard", "slot"]
