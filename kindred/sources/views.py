"""A business directory made of the documents table, for tests and benchmarks: exact and near copies give true matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTITIES = """
SELECT doc_id AS ord,
       concat('S', cast(doc_id % 3 + 1 AS {text}), '-', cast(doc_id AS {text})) AS entity_id,
       concat(substr(text, 1, 40),
              CASE doc_id % 4 WHEN 0 THEN ' Pvt. Ltd.' WHEN 1 THEN ' Private Limited' WHEN 2 THEN ' & Co.' ELSE '' END) AS business_name,
       CASE WHEN doc_id % 11 = 0 THEN NULL
            ELSE concat(cast(n_chars % 500 + 10 AS {text}), ' Main St., Fl. ', cast(n_chars % 7 AS {text}), ' #', cast(n_chars AS {text})) END AS business_address,
       CASE WHEN doc_id % 17 = 0 THEN NULL ELSE upper(lang) END AS country,
       lower(substr(text, 1, 60)) AS truth_key
FROM {table}"""


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ord, entity_id, business_name, business_address, country, truth_key); ids begin S1-, S2- or S3-."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return spark.sql(ENTITIES.format(text="STRING", table="{docs}"), docs=docs)


def source(rows: DataFrame, *numbers: int) -> DataFrame:
    return rows.filter(F.substring("entity_id", 2, 1).isin(*map(str, numbers)))


def truth(rows: DataFrame) -> DataFrame:
    """(source1_entity_id, matched_entity_ids) of the entities: targets with the same first 60 characters, in order of ord."""
    target = source(rows, 2, 3).select("truth_key", F.struct("ord", "entity_id").alias("t"))
    lists = target.groupBy("truth_key").agg(F.array_sort(F.collect_list("t")).alias("l"))
    ids = F.coalesce(F.array_join(F.transform("l", lambda x: x["entity_id"]), ","), F.lit(""))
    return source(rows, 1).join(lists, "truth_key", "left").select("ord", F.col("entity_id").alias("source1_entity_id"), ids.alias("matched_entity_ids"))
