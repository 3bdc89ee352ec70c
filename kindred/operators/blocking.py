"""Candidates by weighted keys with bounded postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.config import DEFAULT, Settings
from kindred.functions import normalize as N

# Words that say nothing of an entity.
GENERIC = (
    "and the of in for with at by from pvt ltd private limited corp corporation inc incorporated co company llc llp gmbh sa sarl "
    "enterprises services solutions group holdings industries international global india us usa france uk store shop center centre"
).split()
#: Order of kinds, by which a candidate's first hit counts.
KINDS = ("exact", "bigram", "first", "salient", "number")


def _entry(kind: str, place: Column, key: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), F.lit(KINDS.index(kind)).alias("prio"), place.cast("int").alias("place"), key.alias("key"))


def key_entries(name: Column, address: Column, country: Column) -> dict[str, Column]:
    """For each kind an array of (kind, prio, place, key): the whole name; the first three pairs of words; the first word of
    three letters or more; the three longest words of four letters or more (earlier ones first, repeated ones kept); the
    distinct of the first two numbers of the address, with the country if there is one."""
    name, address, country = (F.btrim(F.coalesce(c, F.lit(""))) for c in (name, address, country))
    none = F.array().cast("array<struct<kind:string,prio:int,place:int,key:string>>")
    words = N.tokens(name)
    telling = lambda t: ~t.isin(*GENERIC)
    first = F.try_element_at(words, F.lit(1))
    pairs = F.transform(F.slice(words, 1, 3), lambda t, i: F.concat(t, F.lit("_"), F.try_element_at(words, (i + 2).cast("int"))))
    long = F.filter(F.transform(words, lambda t, i: F.struct((-F.length(t)).alias("l"), i.alias("i"), t.alias("t"))), lambda x: (F.length(x["t"]) >= 4) & telling(x["t"]))
    numbers = F.array_distinct(F.slice(N.number_tokens(address), 1, 2))
    scoped = lambda t: F.when(country == "", t).otherwise(F.concat(country, F.lit("|"), t))
    return {
        "exact": F.when(name != "", F.array(_entry("exact", F.lit(0), name))).otherwise(none),
        "bigram": F.filter(F.transform(pairs, lambda k, i: _entry("bigram", i, k)), lambda e: e["key"].isNotNull()),
        "first": F.when((F.length(first) >= 3) & telling(first), F.array(_entry("first", F.lit(0), first))).otherwise(none),
        "salient": F.transform(F.slice(F.array_sort(long), 1, 3), lambda x, i: _entry("salient", i, x["t"])),
        "number": F.transform(numbers, lambda t, i: _entry("number", i, scoped(t))),
    }


def keys(rows: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """(ord, entity_id, country, kind, prio, place, key) of a cleaned table, in one pass over it."""
    entries = key_entries(F.col("business_name_clean"), F.col("business_address_clean"), F.col("country_clean"))
    return rows.select("ord", "entity_id", F.col("country_clean").alias("country"), F.inline(F.concat(*(entries[k] for k in kinds))))


def union_targets(*tables: DataFrame) -> DataFrame:
    """All rows with src_rank; postings are filled in the order of the tables, then of ord."""
    out = None
    for i, t in enumerate(tables):
        own = t.withColumn("src_rank", F.lit(i))
        out = own if out is None else out.unionByName(own)
    return out


def postings(targets: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """(kind, key, entity_id, rn): the first targets of each key in order of the tables. The bound of rn is a literal, so that
    Spark drops all later rows of a key in each task, before they are exchanged."""
    assert settings.cap_number <= settings.cap, "numbers get a smaller cap than names"
    found = targets.select("src_rank", "ord", "entity_id", F.col("country_clean").alias("country"), F.inline(F.concat(*key_entries(*(F.col(c) for c in ("business_name_clean", "business_address_clean", "country_clean"))).values())))
    order = Window.partitionBy("kind", "key").orderBy("src_rank", "ord", "place")
    ranked = found.withColumn("rn", F.row_number().over(order))
    bounded = ranked.filter((F.col("rn") <= settings.cap) & ((F.col("kind") != "number") | (F.col("rn") <= settings.cap_number)))
    return bounded.select("kind", "key", "entity_id", "rn")


def attributes(targets: DataFrame) -> DataFrame:
    """(entity_id, name, address, country) of each target: the last row's, the country the last that isn't blank."""
    place = F.struct("src_rank", "ord")
    row = F.struct(F.col("business_name_clean").alias("name"), F.col("business_address_clean").alias("address"))
    found = targets.groupBy("entity_id").agg(F.max_by(row, place).alias("r"), F.max_by("country_clean", F.when(F.col("country_clean") != "", place)).alias("c"))
    return found.select("entity_id", "r.name", "r.address", F.coalesce("c", F.lit("")).alias("country"))


def hits(probes: DataFrame, posted: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """(s1_id, target_id, score, first_hit): the sum of weights over each occurrence on either side. A key has a bounded
    number of postings and an entity a bounded number of keys, so the join grows with the probes alone; a frequent key on
    the probes' side is split by adaptive execution."""
    weight = F.element_at(F.create_map(*(F.lit(x) for pair in settings.weights for x in pair)), F.col("kind"))
    asked = keys(probes).select(F.col("entity_id").alias("s1_id"), "kind", "key", "prio", "place", weight.alias("weight"))
    joined = asked.join(posted.select("kind", "key", F.col("entity_id").alias("target_id"), "rn"), ["kind", "key"])
    return joined.groupBy("s1_id", "target_id").agg(F.sum("weight").cast("long").alias("score"), F.min(F.struct("prio", "place", "rn")).alias("first_hit"))


def last_rows(rows: DataFrame) -> DataFrame:
    """One row for each id, the last: what a repeated id of the first table is looked up by."""
    last = rows.groupBy("entity_id").agg(F.max("ord").alias("ord"))
    return rows.join(last, ["entity_id", "ord"], "left_semi")


def compatible(found: DataFrame, probes: DataFrame, looked_up: DataFrame) -> DataFrame:
    """Hits without those whose countries are both known and differ."""
    own = last_rows(probes).select(F.col("entity_id").alias("s1_id"), F.col("country_clean").alias("c1"))
    other = looked_up.select(F.col("entity_id").alias("target_id"), F.col("country").alias("c2"))
    return found.join(own, "s1_id").join(other, "target_id").filter("c1 = '' or c2 = '' or c1 = c2").drop("c1", "c2")


def candidates(probes: DataFrame, targets: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """(s1_id, target_id, score, rank): the best targets of each entity; ties by what was hit first."""
    return candidates_from(probes, postings(targets, settings), attributes(targets), settings)


def candidates_from(probes: DataFrame, posted: DataFrame, looked_up: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """candidates() with postings and attributes of the targets that are made already."""
    found = compatible(hits(last_rows(probes), posted, settings), probes, looked_up)
    best = Window.partitionBy("s1_id").orderBy(F.desc("score"), "first_hit")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= settings.top).select("s1_id", "target_id", "score", "rank")


def candidate_recall(spine: DataFrame, found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: true pairs, those among the candidates, recall, and average, median and most candidates of an entity. truth:
    (s1_id, target_id); entities outside the spine are left out."""
    own = spine.select(F.col("entity_id").alias("s1_id")).distinct()
    sizes = own.join(found.groupBy("s1_id").agg(F.count(F.lit(1)).alias("n")), "s1_id", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    a = sizes.agg(
        F.round(F.coalesce(F.avg("n"), F.lit(0.0)), 6).alias("avg_candidates"),
        F.coalesce(F.median("n"), F.lit(0.0)).alias("median_candidates"),
        F.coalesce(F.max("n"), F.lit(0)).cast("long").alias("max_candidates"),
        F.round(F.coalesce(100 * F.avg(F.when(F.col("n") == 0, 1.0).otherwise(0.0)), F.lit(0.0)), 6).alias("zero_percent"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total_pairs"),
    )
    marked = truth.join(own, "s1_id", "left_semi").join(found.select("s1_id", "target_id", F.lit(1).alias("hit")), ["s1_id", "target_id"], "left")
    b = marked.agg(F.count(F.lit(1)).alias("true_pairs"), F.count("hit").alias("found_pairs"))
    both = a.crossJoin(b)  # one row each
    return both.withColumn("recall", F.round(F.coalesce(F.try_divide(F.col("found_pairs").cast("double"), F.col("true_pairs").cast("double")), F.lit(0.0)), 6))
