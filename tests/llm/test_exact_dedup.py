import hashlib

import pytest
from pyspark.sql import functions as F

from kindred.llm.exact_dedup import content_sort

ROWS = [(1, "a"), (2, "a"), (3, "b"), (4, None), (5, ""), (6, "a "), (None, "a"), (2, "a"), (7, "x" * 200_000), (8, "x" * 200_000), (9, "x" * 199_999 + "y"), (None, "z")]


def brute(rows, keep):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    pick = {t: keep([i for i in ids if i is not None], default=None) for t, ids in groups.items()}
    return sorted((str(i), str(pick[t or ""]), len(groups[t or ""])) for i, t in rows), pick


@pytest.mark.parametrize("keep", ["min", "max"])
@pytest.mark.parametrize("hot_rows", [1, 1000])
def test_groups(spark, keep, hot_rows):
    docs = spark.createDataFrame([(i, t, "old", k) for k, (i, t) in enumerate(ROWS)], "doc_id long, text string, kept string, more int").repartition(3)
    got = content_sort(docs, keep=keep, hot_rows=hot_rows)
    assert got.columns == ["doc_id", "text", "more", "keep_id", "group_size", "kept"]
    rows = got.collect()
    want, pick = brute(ROWS, {"min": min, "max": max}[keep])
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size) for r in rows) == want
    assert sorted(map(str, (r.text for r in rows))) == sorted(str(t) for _, t in ROWS)
    stays = [r for r in rows if r.kept]
    assert len(stays) == len(pick) and {(r.text or "", r.doc_id) for r in stays} == set(pick.items())


def test_hot_group_is_salted(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("text"))
    rows = content_sort(docs, keep="max", hot_rows=10).filter("text = 'same'").collect()
    assert len(rows) == 1000 and {r.keep_id for r in rows} == {2997} and {r.group_size for r in rows} == {1000} and [r.doc_id for r in rows if r.kept] == [2997]


def test_normaliser_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "A b"), (2, "a B")], "doc_id long, text string")
    assert [(r.text, r.kept) for r in content_sort(docs, normalise=F.lower).orderBy("doc_id").collect()] == [("A b", True), ("a B", False)]
    assert content_sort(docs.limit(0)).collect() == []


def test_query(spark):
    from kindred.llm.queries import op4_content_sort
    from tests.conftest import SMALL

    for r in op4_content_sort(spark, SMALL).join(spark.read.parquet(f"{SMALL}/documents.parquet"), "doc_id").collect():
        assert r.text_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_names_and_equal_ids(spark):
    """Hot copies of one id are dealt by their place; columns of any name stay."""
    docs = spark.range(900).select(F.lit(7).alias("doc_id"), F.lit("same").alias("text"), F.col("id").alias("a.b"), F.lit(1).alias("__fp"), F.lit(2).alias("KEPT"), F.lit(3).alias("salt")).repartition(4)
    got = content_sort(docs, hot_rows=50)
    assert got.columns == ["doc_id", "text", "a.b", "__fp", "salt", "keep_id", "group_size", "kept"]
    rows = got.collect()
    assert len({r["a.b"] for r in rows}) == 900 and {r.group_size for r in rows} == {900} and sum(r.kept for r in rows) == 1
