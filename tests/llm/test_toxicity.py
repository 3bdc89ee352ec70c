import numpy as np

from kindred.llm import toxicity as X

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = X.grades(docs, labels, sample=2500).join(labels, "doc_id").select("doc_id", "severity", labels["toxic"].alias("label"), "grade", X.F.col("severity") > 0.5).collect()
    picked = {r[0] for r in labels.select("doc_id", X.F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(2500).collect()}
    test = [r for r in rows if r.doc_id not in picked]
    assert len(test) > 1000
    bad = [r.severity for r in test if r.label]
    good = [r.severity for r in test if not r.label]
    assert np.median(bad) > 1.5 and np.median(good) < 0.1
    assert np.mean([s > 0.5 for s in bad]) > 0.8 and np.mean([s > 0.5 for s in good]) < 0.01


def test_shared_weights_and_rising_cuts():
    texts = ["good day"] * 60 + ["bad day"] * 20 + ["bad bad bad bad bad day"] * 20
    model = X.fit(texts, [0] * 60 + [1] * 20 + [2] * 20)
    assert (np.diff(model.cuts) > 0).all() and model.weights[model.words["bad"]] > 0
    tails = [model.at_least(X.features(t)) for t in ("day", "bad", "bad bad", "bad " * 9)]
    assert all((np.diff(t) <= 0).all() for t in tails)
    severity = [t.sum() for t in tails]
    assert severity == sorted(severity) and severity[0] < 0.5 < severity[-1]


def test_fit_is_the_maximum(spark):
    """The likelihood, written out row by row, is lower wherever a weight or a cut is changed."""
    r = np.random.default_rng(2)
    texts = [" ".join(r.choice(["a", "b", "c", "d"], 6, p=[0.1, 0.2, 0.3, 0.4] if i % 2 else [0.4, 0.3, 0.2, 0.1])) for i in range(300)]
    grade = [min(2, int(r.random() < 0.7) * t.count("a") // 2) for t in texts]
    model = X.fit(texts, grade, steps=3000, rate=0.02)
    assert model.words

    def loss(weights, cuts):
        out = 5e-3 * (weights**2).sum()  # half of ten times the ridge
        for t, g in zip(texts, grade, strict=True):
            x = sum(weights[i] * (1 + np.log(t.split().count(w))) for w, i in model.words.items() if w in t.split())
            p = [1.0, *(1 / (1 + np.exp(c - x)) for c in cuts), 0.0]
            out -= np.log(p[g] - p[g + 1])
        return out

    best = loss(model.weights, model.cuts)
    for i in range(len(model.weights)):
        for d in (-0.1, 0.1):
            assert loss(model.weights + d * (np.arange(len(model.weights)) == i), model.cuts) > best
    for d in ([0.1, 0], [-0.1, 0], [0, 0.1], [0, -0.1]):
        assert loss(model.weights, model.cuts + np.array(d)) > best


def test_query_against_plain_scoring(spark):
    """The registered query's rows from the same model, fitted on the same documents and written out word by word."""
    from kindred.llm.queries import op1_ordinal_toxicity
    from tests.conftest import SMALL

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    graded = {r.doc_id: r.toxic * (1 + r.quality) for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect() if r.doc_id in docs}
    ids = sorted(graded, key=str)
    model = X.fit([docs[i] for i in ids], [graded[i] for i in ids])
    rows = op1_ordinal_toxicity(spark, SMALL).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        found = [w.strip(X.EDGES) for w in (docs[r.doc_id] or "").lower().split()]
        x = sum(model.weights[i] * (1 + np.log(found.count(w))) for w, i in model.words.items() if w in found)
        tail = [1 / (1 + np.exp(c - x)) for c in model.cuts]
        assert abs(r.severity - sum(tail)) < 1e-9 and r.toxic == (tail[0] > 0.5)
        share = [1 - tail[0], tail[0] - tail[1], tail[1]]
        assert share[r.grade] >= max(share) - 1e-9


def test_ties_and_bounds(spark):
    """Repeated rows, several labels of one id, texts that are too large for the driver's share."""
    docs = spark.createDataFrame([(1, "bad day"), (1, "bad day"), (2, "x" * 5000), (3, "day"), (3, "a day")], "doc_id long, text string")
    picked = spark.createDataFrame([(1,), (2,), (3,), (4,)], "id long")
    assert X.sampled_texts(docs.withColumnRenamed("doc_id", "id"), picked, 1000) == {1: "bad day", 3: "day"}
    labels = spark.createDataFrame([(1, 0, 1), (1, 1, 0), (2, 1, None), (3, 0, 1)], "doc_id long, toxic int, quality int")
    rows = X.grades(docs, labels).collect()
    assert len(rows) == 5 and len({(r.severity, r.grade) for r in rows if r.doc_id == 1}) == 1


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "bad"), (2, None), (None, "x"), (1, "bad"), (3, "w " * 100_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (9, None), (2, 0)], "doc_id long, toxic int")
    got = X.grades(docs.withColumn("toxic", X.F.lit("old")), labels).collect()
    assert len(got) == 5 and all(0 <= r.severity <= 2 and r.grade in (0, 1, 2) for r in got)
    assert X.grades(docs.limit(0), labels).collect() == []
    assert [r.toxic for r in X.grades(docs, labels.limit(0)).collect()] == [False] * 5
