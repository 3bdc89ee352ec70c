"""Reading and writing the tables of a linkage."""

from __future__ import annotations

import atexit
import contextlib
import json
import re
import tempfile
import uuid
import warnings
from pathlib import Path

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SOURCE_COLUMNS = ("entity_id", "business_name", "business_address", "country")
TRUTH_COLUMNS = ("source1_entity_id", "matched_entity_ids")
# Texts that stand for a missing one.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def text_schema(columns) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def header(spark: SparkSession, path: str, sep: str) -> list[str]:
    """Names in the first line, by Spark's own reader, so that any store will do."""
    first = spark.read.text(path).limit(1).collect()
    return first[0][0].rstrip("\r").lstrip("﻿").split(sep) if first else []


def read_table(spark: SparkSession, path: str, required: tuple[str, ...] = SOURCE_COLUMNS, sep: str = "\t", missing: bool = True, multiline: bool = True) -> DataFrame:
    """A delimited file with a header, or a folder of such files, all columns text; ValueError if a required column isn't
    there. Extra columns stay. Quotes are doubled within quotes and may hold line breaks; a file is one task then, so give
    multiline=False for large files whose fields have none: they are split. missing: texts that stand for missing ones become
    null.

    ord numbers the rows by file name, then by place in the file; it is taken right at the scan, so keep the table in Parquet
    from here on."""
    names = header(spark, path, sep)
    if lacking := [c for c in required if c not in names]:
        raise ValueError(f"{path}: missing columns {lacking}; found {names}")
    options = dict(sep=sep, header=True, quote='"', escape='"', multiLine=multiline, encoding="UTF-8", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    read = lambda at: spark.read.schema(text_schema(names)).csv(at, **options)
    rows = read(path)
    files = sorted(rows.inputFiles())
    if len(files) > 1:  # one scan would deal files to tasks by their sizes; partitions of a union are in its order
        rows = read(files[0])
        for f in files[1:]:
            rows = rows.union(read(f))
    if missing:
        rows = rows.select(*(F.when(~F.col(c).isin(*MISSING), F.col(c)).alias(c) for c in names))
    return rows.withColumn("ord", F.monotonically_increasing_id())


def find_data_paths(root: str) -> tuple[Path, Path]:
    """Folders of training and test tables below a local root."""
    base, found = Path(root), []
    for names in (("dataset/train", "train", "train_"), ("dataset/test", "test")):
        hit = next((base / n for n in names if (base / n).is_dir()), None)
        if hit is None:
            raise FileNotFoundError(f"none of {', '.join(names)} below {root}")
        found.append(hit)
    return found[0], found[1]


def load_all(spark: SparkSession, train: str, test: str, multiline: bool = True) -> dict[str, DataFrame]:
    """The seven tables of a data set, none of them read yet."""
    tables = {f"{part}_source{i}": read_table(spark, f"{path}/{part}_source{i}.tsv", multiline=multiline) for part, path in (("train", train), ("test", test)) for i in (1, 2, 3)}
    return tables | {"train_ground_truth": read_table(spark, f"{train}/train_ground_truth.tsv", TRUTH_COLUMNS, missing=False)}


def save_clean(tables: dict[str, DataFrame], folder: str) -> None:
    """One Parquet folder for each table; later stages read only the columns they need."""
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{folder}/{name}_clean")


def load_clean(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}_clean")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a written table is there."""
    try:
        spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return False
    return True


def split_ids(ids: Column) -> Column:
    """Ids of a comma-separated list, trimmed, without blanks; [] for null."""
    return F.filter(F.transform(F.split(F.coalesce(ids, F.lit("")), ","), lambda x: F.btrim(x)), lambda x: x != "")


def truth_pairs(truth: DataFrame) -> DataFrame:
    """(s1_id, target_id) of a ground-truth table, repeated ids kept."""
    return truth.select(F.col("source1_entity_id").alias("s1_id"), F.explode(split_ids(F.col("matched_entity_ids"))).alias("target_id"))


def id_lists(spine: DataFrame, ranked: DataFrame, name: str) -> DataFrame:
    """(ord, source1_entity_id, name): for each row of spine (ord, entity_id) its targets of (s1_id, target_id, rank), by rank,
    separated by commas; '' for none. A target that comes again is listed at its first place."""
    once = ranked.groupBy("s1_id", "target_id").agg(F.min("rank").alias("rank"))
    lists = once.groupBy("s1_id").agg(F.array_sort(F.collect_list(F.struct("rank", "target_id"))).alias("l"))
    joined = spine.select("ord", "entity_id").join(lists, F.col("entity_id") == F.col("s1_id"), "left")
    text = F.coalesce(F.array_join(F.transform("l", lambda x: x["target_id"]), ","), F.lit(""))
    return joined.select("ord", F.col("entity_id").alias("source1_entity_id"), text.alias(name))


def write_lists(lists: DataFrame, path: str, single: bool = False) -> None:
    """A tab-separated table with a header, in the order of ord; one file only for an export that needs one."""
    rows = lists.orderBy("ord").drop("ord")
    (rows.coalesce(1) if single else rows).write.mode("overwrite").csv(path, sep="\t", header=True, emptyValue="", quote='"', escape='"')


def save_log(spark: SparkSession, path: str, entries: dict) -> None:
    """JSON of one entry a run, through Spark's writer, so that it lies in any store that the tables lie in (a folder there)."""
    spark.createDataFrame([(json.dumps(entries, indent=2, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_log(spark: SparkSession, path: str) -> dict | None:
    """What save_log wrote; None if nothing is there."""
    try:
        return json.loads(spark.read.text(path, wholetext=True).first()[0])
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def logged_threshold(spark: SparkSession, path: str, default: float) -> float:
    """The threshold of the last training run, or the default, with a warning, where there is none. A log that can't be read
    is an error."""
    log = load_log(spark, path)
    if log is None:
        warnings.warn(f"no log at {path}; the threshold is {default}", stacklevel=2)
        return default
    return float(log["best_threshold"])


def shared_folder(spark: SparkSession) -> str | None:
    """The folder that driver and executors share: the session's checkpoint folder. Where none is set, a local one, if all tasks
    run in this process; None on a cluster."""
    sc = spark.sparkContext
    if found := sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir"):
        return found
    return f"file://{tempfile.mkdtemp(prefix='kindred-')}" if re.match(r"local(\[|$)", sc.master) else None


def delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def delete_if_possible(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        delete(spark, path)


#: Whether Spark deletes the files of a query's exchanges when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def kept(rows: DataFrame) -> DataFrame:
    """The rows, made once: in the shared folder until this process ends, or, without one, persisted. Files of exchanges go as
    soon as the rows are written; those behind persisted rows would stay as long as these."""
    spark = rows.sparkSession
    if not (at := shared_folder(spark)):
        return rows.persist(StorageLevel.DISK_ONLY)
    path = f"{at.rstrip('/')}/rows-{uuid.uuid4().hex}"
    atexit.register(delete_if_possible, spark, path)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        rows.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(rows.schema).parquet(path)
