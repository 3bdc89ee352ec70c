"""Files, whole runs and the command line on a small made data set."""

import csv
import random

import pytest

from kindred.__main__ import main
from kindred.plans import runs
from kindred.sources import tables
from kindred.streaming.arrivals import link_arrivals


def write(path, header, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("w", newline="", encoding="utf-8") as f:
        out = csv.writer(f, delimiter="\t", quotechar='"', lineterminator="\n")
        out.writerow(header)
        out.writerows(rows)


@pytest.fixture(scope="module")
def folders(tmp_path_factory):
    """Ten businesses in the first source for each part, most with copies in the others."""
    root, r = tmp_path_factory.mktemp("data"), random.Random(1)
    word = lambda: "".join(r.choice("abcdefghiklmnoprstu") for _ in range(r.randint(4, 9)))
    for part in ("train", "test"):
        s1, s2, s3, truth = [], [], [], []
        for i in range(60):
            name, address = f"{word()} {word()}", f"{r.randint(10, 9999)} {word()} Rd."
            s1.append([f"S1-{i}", f"{name} Pvt. Ltd.", address, "IN"])
            mine = []
            if i % 3:
                s2.append([f"S2-{i}", f"{name.upper()} Private Limited", address, "IN"])
                mine.append(f"S2-{i}")
            if i % 2:
                s3.append([f"S3-{i}", name, address.replace("Rd.", "Road"), "NA"])
                mine.append(f"S3-{i}")
            s2.append([f"S2-9{i}", f"{word()} {name.split()[1]}", f"{r.randint(10, 9999)} {word()} St", "IN"])
            truth.append([f"S1-{i}", ",".join(mine)])
        for k, rows in enumerate((s1, s2, s3), 1):
            write(root / part / f"{part}_source{k}.tsv", tables.SOURCE_COLUMNS, rows)
        if part == "train":
            write(root / part / "train_ground_truth.tsv", tables.TRUTH_COLUMNS, truth)
    return root


def test_reading(spark, tmp_path):
    write(tmp_path / "a.tsv", (*tables.SOURCE_COLUMNS, "more"), [["S1-1", 'q"q\nline', "NA", "nil", "x"], ["S1-2", "null", "", "N/A", "y"]])
    rows = tables.read_table(spark, str(tmp_path / "a.tsv")).orderBy("ord").collect()
    assert [tuple(r)[:5] for r in rows] == [("S1-1", 'q"q\nline', None, "nil", "x"), ("S1-2", None, None, None, "y")]
    assert [r.entity_id for r in tables.read_table(spark, str(tmp_path / "a.tsv"), missing=False).orderBy("ord").collect()] == ["S1-1", "S1-2"]
    write(tmp_path / "b.tsv", ("entity_id", "country"), [["S1-1", "x"]])
    with pytest.raises(ValueError, match="business_name"):
        tables.read_table(spark, str(tmp_path / "b.tsv"))


def test_paths(folders, tmp_path):
    assert tables.find_data_paths(str(folders)) == (folders / "train", folders / "test")
    with pytest.raises(FileNotFoundError):
        tables.find_data_paths(str(tmp_path))


def test_log(spark, tmp_path):
    path = f"file://{tmp_path}/x/log"  # by Spark's file system, whatever the scheme
    with pytest.warns(UserWarning, match="0.65"):
        assert tables.logged_threshold(spark, path, 0.65) == 0.65
    for t in (0.5, 0.72):
        tables.save_log(spark, path, {"best_threshold": t})
    assert tables.logged_threshold(spark, path, 0.65) == 0.72 and (tmp_path / "x" / "log").is_dir()
    tables.save_log(spark, path, {"other": 1})
    with pytest.raises(KeyError):
        tables.logged_threshold(spark, path, 0.65)


def test_files_are_numbered_by_name(spark, tmp_path):
    """Whatever their sizes: one scan would take the largest first."""
    for k, n in ((1, 3), (2, 2000), (3, 10)):
        write(tmp_path / "in" / f"part{k}.tsv", tables.SOURCE_COLUMNS, [[f"S1-{k}-{i}", "n", "a", "c"] for i in range(n)])
    want = [f"S1-{k}-{i}" for k, n in ((1, 3), (2, 2000), (3, 10)) for i in range(n)]
    for multiline in (True, False):
        rows = tables.read_table(spark, str(tmp_path / "in"), multiline=multiline)
        assert [r.entity_id for r in rows.orderBy("ord").collect()] == want


def test_inspection(spark, tmp_path):
    from kindred.operators import cleaning

    write(tmp_path / "a.tsv", tables.SOURCE_COLUMNS, [["S1-1", "x", "", "IN"], ["S1-1", "y", "z", "IN"], ["S1-2", "NA", "z", ""], ["S1-3", "q", "r", "US"]])
    got = cleaning.inspect_all({"a": tables.read_table(spark, str(tmp_path / "a.tsv")), "t": spark.createDataFrame([], "source1_entity_id string, ord long")})
    assert got["a"]["rows"] == 4 and got["a"]["columns"] == list(tables.SOURCE_COLUMNS) and got["a"]["repeated_ids"] == 1
    assert got["a"]["missing"]["business_name"] == [1, 25.0] and got["a"]["top_countries"] == [["IN", 2], ["US", 1], [None, 1]]
    assert got["a"]["first_rows"][0] == ["S1-1", "x", None, "IN"] and len(got["a"]["first_rows"]) == 3
    assert got["t"] == {"rows": 0, "columns": ["source1_entity_id"], "missing": {"source1_entity_id": [0, 0.0]}, "repeated_ids": 0, "top_countries": None, "first_rows": []}


def test_whole_run(spark, folders, tmp_path):
    out = str(tmp_path / "out")
    common = ["--train-dir", str(folders / "train"), "--test-dir", str(folders / "test"), "--out", out, "--trees", "3", "--single-file"]
    assert main(["--stage", "all", *common]) == 0
    found = spark.read.csv(f"{out}/matching_results", sep="\t", header=True)
    assert found.count() == 60
    hits = {r[0]: set((r[1] or "").split(",")) - {""} for r in found.collect()}
    right = sum(f"S2-{i}" in hits[f"S1-{i}"] for i in range(60) if i % 3)
    assert right > 30
    assert [r[0] for r in found.collect()] == [f"S1-{i}" for i in range(60)]
    before = sorted(map(tuple, found.collect()))
    assert tables.load_log(spark, f"{out}/clean/inspection")["test_source1"]["rows"] == 60
    log, model = tables.load_log(spark, f"{out}/log"), sorted((p.name, p.stat().st_mtime_ns) for p in (tmp_path / "out" / "model").rglob("*"))
    assert log["metrics"]["pairs_mode"] == log["mode"] == "blocked"
    tables.save_log(spark, f"{out}/log", {})
    assert main(["--stage", "evaluate", *common]) == 0  # the same log again, from the saved model, which stays as it is
    assert tables.load_log(spark, f"{out}/log") == log
    assert model == sorted((p.name, p.stat().st_mtime_ns) for p in (tmp_path / "out" / "model").rglob("*"))
    assert main(["--stage", "candidates", *common]) == 0
    assert main(["--stage", "predict", *common]) == 0  # a saved model gives the same
    assert sorted(map(tuple, spark.read.csv(f"{out}/matching_results", sep="\t", header=True).collect())) == before
    assert runs.validate(spark, f"{out}/nothing", f"{out}/candidate_pairs", str(folders / "test" / "test_source1.tsv")) == {"match_missing": 1}
    swapped = runs.validate(spark, f"{out}/candidate_pairs", f"{out}/matching_results", str(folders / "test" / "test_source1.tsv"))
    assert swapped == {"match_header": 1, "candidate_header": 1}


def test_arrivals(spark, folders, tmp_path):
    from kindred.operators import blocking, cleaning

    raw = tables.read_table(spark, str(folders / "test" / "test_source1.tsv"))
    raw.write.parquet(str(tmp_path / "in"))
    targets = blocking.union_targets(cleaning.clean_table(tables.read_table(spark, str(folders / "test" / "test_source2.tsv"))))
    stream = spark.readStream.schema(raw.schema).parquet(str(tmp_path / "in"))
    link_arrivals(stream, targets, str(tmp_path / "found"), str(tmp_path / "state")).awaitTermination()
    got = sorted((r.s1_id, r.target_id, r["rank"]) for r in spark.read.parquet(str(tmp_path / "found")).collect())
    assert got == sorted((r.s1_id, r.target_id, r["rank"]) for r in blocking.candidates(cleaning.clean_table(raw), targets).collect())
