import pytest

from kindred.operators import blocking, cleaning, metrics, pairs, submission
from kindred.operators.features import FEATURES, pair_features

CLEAN = "ord long, entity_id string, business_name_clean string, business_address_clean string, country_clean string"
TARGETS = [
    (0, "S2-1", "sharma sweets", "12 mg road 560001", "in"),
    (1, "S2-2", "sharma sweets company", "", "us"),
    (2, "S2-3", "taj taj hotel hotel", "45 beach road", ""),
    (3, "S3-1", "", "12 main street", "in"),
    (4, "S3-2", "sharma traders", "99 x", ""),
]
PROBES = [
    (0, "S1-1", "sharma sweets", "12 mg road 560001", "in"),
    (1, "S1-2", "hotel hotel", "", ""),
    (2, "S1-3", "the co", "", ""),
    (3, "S1-4", "", "12 lane", ""),
]


@pytest.fixture(scope="module")
def directory(spark):
    return spark.createDataFrame(PROBES, CLEAN), blocking.union_targets(spark.createDataFrame(TARGETS, CLEAN))


def test_candidates(directory):
    s1, targets = directory
    got = {(r.s1_id, r.target_id): (r.score, r.rank) for r in blocking.candidates(s1, targets).collect()}
    assert got == {("S1-1", "S2-1"): (32, 1), ("S1-1", "S3-2"): (7, 2), ("S1-1", "S3-1"): (2, 3), ("S1-2", "S2-3"): (18, 1)}


def test_repeated_ids(spark):
    s1 = spark.createDataFrame([(0, "S1-1", "alpha works", "", ""), (1, "S1-1", "gamma works", "", "")], CLEAN)
    s2 = spark.createDataFrame([(0, "S2-1", "alpha works", "", "in"), (1, "S2-1", "gamma works", "", "")], CLEAN)
    targets = blocking.union_targets(s2)
    assert blocking.attributes(targets).collect()[0].asDict() == {"entity_id": "S2-1", "name": "gamma works", "address": "", "country": "in"}
    row = blocking.candidates(s1, targets).collect()[0]
    assert (row.score, row.rank) == (12 + 6 + 4 + 3 + 3 + 3, 1)  # the last row's keys; "works" was posted by both rows


def test_recall(spark, directory):
    s1, targets = directory
    truth = spark.createDataFrame([("S1-1", "S2-1"), ("S1-1", "S2-2"), ("S1-9", "S2-1")], "s1_id string, target_id string")
    row = blocking.candidate_recall(s1, blocking.candidates(s1, targets), truth).first()
    assert (row.true_pairs, row.found_pairs, row.recall) == (2, 1, 0.5)
    assert (row.avg_candidates, row.median_candidates, row.max_candidates, row.zero_percent, row.total_pairs) == (1.0, 0.5, 3, 50.0, 4)
    nothing = blocking.candidate_recall(s1.limit(0), blocking.candidates(s1, targets).limit(0), truth.limit(0)).first()
    assert nothing.recall == 0 and nothing.total_pairs == 0


def entity(spark, ident, name, address="", country=""):
    return spark.createDataFrame([(ident, name, address, country)], "entity_id string, name string, address string, country string")


def features(spark, a, b):
    pairs_ = spark.createDataFrame([("S1-1", "S2-1")], "s1_id string, target_id string")
    return pair_features(pairs_, entity(spark, "S1-1", *a), entity(spark, "S2-1", *b)).first().asDict()


def test_features(spark):
    f = features(spark, ("sharma sweets", "12 mg road", "in"), ("sharma sweets company", "12 main road 77", ""))
    want = {
        "exact_name_match": 0,
        "first_word_match": 1,
        "name_token_jaccard": 2 / 3,
        "name_token_overlap": 1,
        "name_token_dice": 4 / 5,
        "name_char_3gram_jaccard": 11 / 19,
        "name_char_4gram_jaccard": 10 / 18,
        "name_length_diff": 8,
        "name_length_ratio": 13 / 21,
        "name_prefix_match_3": 1,
        "name_prefix_match_5": 1,
        "name_char_overlap_ratio": 9 / 14,
        "name_token_containment": 1,
        "address_token_jaccard": 2 / 5,
        "address_numeric_match": 1,
        "address_numeric_jaccard": 1 / 2,
        "country_exact_match": 0,
        "country_missing_either": 1,
        "is_source2": 1,
        "is_source3": 0,
    }
    assert {k: f[k] for k in want} == pytest.approx(want)
    assert len(FEATURES) == 24 and set(FEATURES) < set(f) and 0 < f["semantic_similarity"] < 1


def test_empty_sides(spark):
    both = features(spark, ("",), ("",))
    assert all(both[k] == 0 for k in FEATURES[:13])
    assert features(spark, ("x",), ("",))["name_token_containment"] == 1
    assert features(spark, ("",), ("x",))["name_token_containment"] == 0


F_CASES = [("", "", 1, 1, 1), ("", "a", 0, 0, 0), ("a", "", 0, 0, 0), ("a", "b", 0, 0, 0), ("ab", "ac", 0.5, 0.5, 0.5), ("ab", "a", 1, 0.5, 0.8333), ("a", "ab", 0.5, 1, 0.5556)]


def test_entity_scores(spark):
    spine = spark.createDataFrame([(str(i),) for i in range(len(F_CASES))], "s1_id string")
    table = lambda k: spark.createDataFrame([(str(i), x) for i, c in enumerate(F_CASES) for x in c[k]], "s1_id string, target_id string")
    rows = {int(r.s1_id): (r.precision, r.recall, r.f) for r in metrics.entity_scores(spine, table(0), table(1)).collect()}
    for i, (_, _, *want) in enumerate(F_CASES):
        assert rows[i] == pytest.approx(want, abs=1e-4)


def test_sweep_equals_each_threshold(spark):
    scores = [("a", "x", 0.1), ("a", "y", 0.2799999), ("a", "z", 0.28), ("b", "x", 0.94), ("b", "w", 1.0), ("c", "x", 0.0999), ("c", "q", 0.3)]
    scored = spark.createDataFrame([(*s, 1) for s in scores], "s1_id string, target_id string, score double, rank int")
    spine = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "s1_id string")
    truth = spark.createDataFrame([("a", "z"), ("b", "x"), ("b", "v"), ("c", "q")], "s1_id string, target_id string")
    for r in metrics.threshold_sweep(spine, truth, scored).collect():
        own = metrics.macro(metrics.entity_scores(spine, truth, metrics.matches(scored, r.threshold))).first()
        assert (r.macro_precision, r.macro_recall, r.macro_f, r.total_predicted_matches) == (own.macro_precision, own.macro_recall, own.macro_f, own.total_predicted_matches), r.threshold
    best = metrics.best_threshold(metrics.threshold_sweep(spine, truth, scored)).first()
    assert best.threshold == 0.28  # of equal ones the lowest


def test_pairs(spark):
    found = spark.createDataFrame([("a", f"t{i}", 1, i) for i in range(1, 6)], "s1_id string, target_id string, score long, rank int")
    truth = spark.createDataFrame([("a", "t2"), ("a", "t9")], "s1_id string, target_id string")
    targets = spark.createDataFrame([("t2",), ("t9",)], "entity_id string")
    blocked = {(r.target_id, r.label) for r in pairs.training_pairs(found, truth, targets, 2).collect()}
    assert blocked == {("t2", 1), ("t1", 0), ("t3", 0)}
    assert {r.target_id for r in pairs.training_pairs(found, truth, targets, 2, "injected").filter("label = 1").collect()} == {"t2", "t9"}


def test_cleaning_checks(spark):
    raw = spark.createDataFrame([(i, f"S1-{i}", "A Co.", None, "IN") for i in range(4)], "ord long, entity_id string, business_name string, business_address string, country string")
    clean = cleaning.clean_table(raw)
    found = lambda after: {r.check_name: r.violations for r in cleaning.check_clean(raw, after).collect() if r.violations}
    assert found(clean) == {}
    assert found(clean.filter("ord > 0"))["row_count"] == 1
    from pyspark.sql import functions as F

    assert found(clean.withColumn("business_name", F.lit("B")))["business_name"] == 4
    assert found(clean.withColumn("country", F.lit("US")))["countries"] == 2
    assert found(clean.drop("name_length"))["added_columns"] == 1
    assert found(clean.na.fill("")) == {}
    empty = {r.column_name: r.null_percent for r in cleaning.profile(raw.limit(0)).collect()}
    assert set(empty.values()) == {0.0}


def lists(spark, name, rows):
    return spark.createDataFrame(rows, f"source1_entity_id string, {name} string")


def test_submission_checks(spark):
    spine = spark.createDataFrame([("S1-1",), ("S1-2",)], "entity_id string")
    c = [("S1-1", "S2-1,S3-1"), ("S1-2", None)]
    bad = lambda m, c=c: {r.check_name: r.violations for r in submission.validate(lists(spark, "matched_entity_ids", m), lists(spark, "candidate_entity_ids", c), spine).collect() if r.violations}
    assert bad([("S1-2", ""), ("S1-1", "S3-1, S2-1")]) == {}
    assert bad([("S1-1", "S2-1")]) == {"match_row_count": 1, "match_ids": 1}
    assert bad([("S1-1", ""), ("S1-9", "")]) == {"match_ids": 2}
    assert bad([("S1-1", "S2-1,S2-1"), ("S1-2", "")]) == {"repeated_ids": 1}
    assert bad([("S1-1", "S1-2"), ("S1-2", "")]) == {"first_source_ids": 1, "foreign_ids": 1, "not_candidates": 1}
    assert bad([("S1-1", "X9-1"), ("S1-2", "")]) == {"foreign_ids": 1, "not_candidates": 1}
    assert bad([("S1-1", ""), ("S1-2", "S2-5")]) == {"not_candidates": 1}
    assert bad([("S1-1", ""), ("S1-2", "")], [("S1-1", "")]) == {"candidate_row_count": 1, "candidate_ids": 1}


def test_sample_of_a_large_table(spark):
    from pyspark.sql import functions as F

    rows = spark.range(3000).select(F.col("id").alias("ord"), F.concat(F.lit("S1-"), "id").alias("entity_id"))
    plain = [r.entity_id for r in rows.orderBy(pairs.place(F.col("entity_id")), "ord").limit(50).collect()]
    assert [r.entity_id for r in pairs.sample(rows, 50).collect()] == plain
    assert pairs.sample(rows, 5000).count() == 3000


def test_probabilities_follow_the_trees(spark):
    """Probabilities of a small model against its trees, walked in plain Python."""
    import math
    import random
    import re
    from dataclasses import replace

    from kindred.config import DEFAULT
    from kindred.operators import model

    r = random.Random(5)
    data = [{f: r.random() for f in FEATURES} for _ in range(300)]
    for x in data:
        x["label"] = int(x["name_token_jaccard"] + 0.3 * x["semantic_similarity"] > 0.7)
    rows = spark.createDataFrame([tuple(x[c] for c in (*FEATURES, "label")) for x in data], ", ".join(f"{f} double" for f in FEATURES) + ", label int")
    for kind in model.KINDS:
        own = model.fit(rows, replace(DEFAULT, trees=2, depth=3), kind=kind)
        trees, weights = own.stages[-1].trees, own.stages[-1].treeWeights
        lines = [[x.strip() for x in t.toDebugString.split("\n")[1:] if x.strip()] for t in trees]

        def value(todo, x):
            """The leaf that x comes to, reading the lines of a tree from the top."""
            if m := re.match(r"Predict: (\S+)", todo[0]):
                return float(m[1]), todo[1:]
            f, cut = re.match(r"If \(feature (\d+) <= (\S+)\)", todo[0]).groups()
            low, rest = value(todo[1:], x)
            high, rest = value(rest[1:], x)
            return (low if x[FEATURES[int(f)]] <= float(cut) else high), rest

        for got in model.predict(own, rows).collect():
            margin = sum(w * value(t, got)[0] for w, t in zip(weights, lines, strict=True))
            assert got.score == pytest.approx(1 / (1 + math.exp(-2 * margin)))


def test_the_plain_model_is_the_fallback(spark):
    from dataclasses import replace

    from kindred.config import DEFAULT
    from kindred.operators import model

    rows = spark.createDataFrame([(*[float(i % 2)] * len(FEATURES), i % 2) for i in range(40)], ", ".join(f"{f} double" for f in FEATURES) + ", label int")
    with pytest.warns(UserWarning, match="plain"):
        own = model.fit(rows, replace(DEFAULT, trees=1, depth=2, subsample=7.0))
    assert own.stages[-1].getSubsamplingRate() == 1.0
    with pytest.raises(ValueError, match="none of"):
        model.fit(rows, kind="other")


def labelled(spark, n, values=17):
    import random

    r = random.Random(11)
    data = [[r.randrange(values) / (values - 1) for _ in FEATURES] for _ in range(n)]
    rows = [(*x, int(x[2] + 0.4 * x[5] + 0.3 * r.random() > 0.9)) for x in data]
    return spark.createDataFrame(rows, ", ".join(f"{f} double" for f in FEATURES) + ", label int")


def scores(model, own, rows):
    return [r.score for r in model.predict(own, rows).orderBy(*FEATURES).select("score").collect()]


def test_more_trees_are_no_more_jobs(spark):
    """A job for each level of each tree took a run of the default settings beyond its time."""
    from dataclasses import replace

    from kindred.config import DEFAULT
    from kindred.operators import model

    rows, jobs = labelled(spark, 300).persist(), {}
    for trees in (2, 12):
        spark.sparkContext.setJobGroup(f"trees-{trees}", "")
        own = model.fit(rows, replace(DEFAULT, trees=trees, depth=3))
        jobs[trees] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"trees-{trees}"))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert len(own.stages[-1].trees) == trees and own.stages[-1].treeWeights == [1.0] + [DEFAULT.rate] * (trees - 1)
    assert 0 < jobs[12] <= jobs[2] + 2


def test_boosting_is_that_of_spark(spark, monkeypatch):
    """With all rows and features in each tree nothing is drawn, and values of few places are bins of their own."""
    from dataclasses import replace

    from kindred.config import DEFAULT
    from kindred.operators import boosting, model

    rows = labelled(spark, 500)
    rows = rows.union(rows.limit(60)).persist()
    settings = replace(DEFAULT, trees=6, depth=4, rate=0.3, subsample=1.0)
    own = model.fit(rows, settings)
    monkeypatch.setattr(boosting, "folder", lambda spark: None)
    other = model.fit(rows, settings)
    assert [t.numNodes for t in own.stages[-1].trees] == [t.numNodes for t in other.stages[-1].trees]
    assert scores(model, own, rows) == pytest.approx(scores(model, other, rows), abs=1e-5)
    assert list(own.stages[-1].featureImportances.toArray()) == pytest.approx(list(other.stages[-1].featureImportances.toArray()), abs=1e-4)


def test_tasks_do_not_change_the_trees(spark, monkeypatch):
    from dataclasses import replace

    from pyspark.sql import functions as F

    from kindred.config import DEFAULT
    from kindred.operators import boosting, model

    rows = labelled(spark, 400, values=101)
    rows = rows.union(rows.limit(100)).persist()
    settings = replace(DEFAULT, trees=5, depth=4)
    one = scores(model, model.fit(rows, settings), rows)
    monkeypatch.setattr(boosting, "TASK_ROWS", 50)
    assert boosting.slots(spark) > 1
    assert scores(model, model.fit(rows.repartition(5), settings), rows) == one and len(set(one)) > 10
    with pytest.raises(Exception, match="null"):
        model.fit(rows.withColumn(FEATURES[3], F.lit(None).cast("double")), settings)


def test_cuts_share_the_rows_out():
    from kindred.operators import boosting

    assert boosting.chosen([], []) == boosting.chosen([1.0], [5]) == []
    assert boosting.chosen([0.0, 1.0, 3.0], [9, 1, 1]) == [0.5, 2.0]
    many = boosting.chosen([float(i) for i in range(320)], [1] * 320)
    assert len(many) == 31 and many[:2] == [9.5, 19.5]
