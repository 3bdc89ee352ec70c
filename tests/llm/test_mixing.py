import random

import pytest
from pyspark.sql import functions as F

from kindred.llm.mixing import mix, source_targets
from tests.conftest import SMALL


def poured(sizes, weights, share, most):
    """Targets by dealing out again and again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    cap = {s: most * sizes[s] for s in names}
    target, free, budget = dict.fromkeys(names, 0.0), set(names), share * sum(sizes.values())
    while free:
        total = sum(w[s] for s in free)
        over = {s for s in free if budget * w[s] / total > cap[s]}
        if not over:
            for s in free:
                target[s] = budget * w[s] / total
            break
        for s in over:
            target[s] = cap[s]
            budget -= cap[s]
        free -= over
    return target


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    r = random.Random(seed)
    sizes = {s: r.choice([0, 1, 10, 100, 1000, r.randint(1, 5000)]) for s in [*"abcdefg", "é", "Z", "", None]}
    rows = source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"), (5, 2, 1), 1.5, 2).collect()
    want = poured(sizes, (5, 2, 1), 1.5, 2)
    assert {x.source: x.target for x in rows} == pytest.approx(want)


def made(spark, n=3000):
    source = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise(F.concat(F.lit("s"), F.col("id") % 7))
    return spark.range(n).select(F.col("id").alias("doc_id"), source.alias("source"), F.repeat(F.lit("w "), (F.col("id") % 40).cast("int")).alias("text"), F.lit(1).alias("size"))


def test_taken(spark):
    docs = made(spark)
    rows = mix(docs).collect()
    assert len(rows) == 3000
    by = {}
    for r in rows:
        assert r.size == r.doc_id % 40 and r.taken in (0, r.size, 2 * r.size)
        by.setdefault(r.source, []).append(r)
    want = poured({s: sum(r.size for r in x) for s, x in by.items()}, (5, 2, 1), 1.5, 2)
    for s, x in by.items():
        assert x[0].source_size == sum(r.size for r in x) and x[0].target == pytest.approx(want[s])
        assert abs(sum(r.taken for r in x) - want[s]) <= 40
    again = mix(docs.repartition(13, "text")).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)


def test_odd_rows(spark):
    rows = [(None, "a", "x y"), (None, "a", "z"), (1, None, None), (2, "b", ""), (3, "b", "\x1cone two\u00a0"), (3, "b", "q"), (4, "", "w " * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mix(docs).collect()
    assert len(got) == len(rows) and sorted(r.size for r in got) == [0, 0, 1, 1, 2, 2, 30_000]
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    assert mix(docs.limit(0)).collect() == []
    nothing = mix(docs.filter("coalesce(text, '') = ''")).collect()
    assert [(r.size, r.target, r.taken) for r in nothing] == [(0, 0.0, 0)] * 2


def test_query_keeps_columns(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert set(docs.columns) <= set(mix(docs).columns)


def test_names(spark):
    docs = spark.createDataFrame([(1, "a", "s", 2, 3, 4)], "doc_id long, text string, `my.source` string, __mine int, `a.b` int, hash int")
    assert mix(docs, source_col="my.source").columns == ["doc_id", "text", "my.source", "__mine", "a.b", "hash", "size", "source_size", "target", "taken"]
