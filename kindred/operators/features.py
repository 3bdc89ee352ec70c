"""The 24 features of a pair of entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions import embedding, sets
from kindred.functions import normalize as N

#: Names in the order that a model expects.
FEATURES = (
    "exact_name_match",
    "first_word_match",
    "name_token_jaccard",
    "name_token_overlap",
    "name_token_dice",
    "name_char_3gram_jaccard",
    "name_char_4gram_jaccard",
    "name_length_diff",
    "name_length_ratio",
    "name_prefix_match_3",
    "name_prefix_match_5",
    "name_char_overlap_ratio",
    "name_token_containment",
    "address_token_jaccard",
    "address_token_overlap",
    "address_char_3gram_jaccard",
    "address_numeric_match",
    "address_numeric_jaccard",
    "address_length_diff",
    "country_exact_match",
    "country_missing_either",
    "is_source2",
    "is_source3",
    "semantic_similarity",
)


def prepared(rows: DataFrame) -> DataFrame:
    """Sets of words, character windows and numbers of (entity_id, name, address, country): made once for each entity, not
    for each of its pairs."""
    own = rows.select("entity_id", *(F.btrim(F.coalesce(c, F.lit(""))).alias(c) for c in ("name", "address", "country")))
    return own.withColumns(
        {
            "first": F.try_element_at(N.tokens(F.col("name")), F.lit(1)),
            "nt": F.array_distinct(N.tokens(F.col("name"))),
            "n3": N.ngram_set(F.col("name"), 3),
            "n4": N.ngram_set(F.col("name"), 4),
            "n1": N.ngram_set(F.col("name"), 1),
            "at": F.array_distinct(N.tokens(F.col("address"))),
            "a3": N.ngram_set(F.col("address"), 3),
            "an": F.array_distinct(N.number_tokens(F.col("address"))),
        }
    )


def feature_columns(a: str = "a", b: str = "b") -> dict[str, Column]:
    """All but the last feature, of two structs of prepared columns."""
    x, y = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
    ln, lm = F.length(x("name")), F.length(y("name"))
    start = lambda n: sets.flag((ln >= n) & (lm >= n) & (F.left(x("name"), F.lit(n)) == F.left(y("name"), F.lit(n))))
    within = (F.size(F.array_except(x("nt"), y("nt"))) == 0) | (F.size(F.array_except(y("nt"), x("nt"))) == 0)
    chars = sets.common(x("n1"), y("n1"))
    return {
        "exact_name_match": sets.flag((x("name") != "") & (x("name") == y("name"))),
        "first_word_match": sets.flag(x("first") == y("first")),
        "name_token_jaccard": sets.jaccard(x("nt"), y("nt")),
        "name_token_overlap": sets.overlap(x("nt"), y("nt")),
        "name_token_dice": sets.dice(x("nt"), y("nt")),
        "name_char_3gram_jaccard": sets.jaccard(x("n3"), y("n3")),
        "name_char_4gram_jaccard": sets.jaccard(x("n4"), y("n4")),
        "name_length_diff": F.abs(ln - lm).cast("double"),
        "name_length_ratio": F.least(ln, lm) / F.greatest(ln, lm, F.lit(1)),
        "name_prefix_match_3": start(3),
        "name_prefix_match_5": start(5),
        "name_char_overlap_ratio": chars / F.greatest(F.size(x("n1")) + F.size(y("n1")) - chars, F.lit(1)),
        "name_token_containment": sets.flag((F.size(x("nt")) > 0) & within),
        "address_token_jaccard": sets.jaccard(x("at"), y("at")),
        "address_token_overlap": sets.overlap(x("at"), y("at")),
        "address_char_3gram_jaccard": sets.jaccard(x("a3"), y("a3")),
        "address_numeric_match": sets.flag(sets.common(x("an"), y("an")) > 0),
        "address_numeric_jaccard": sets.jaccard(x("an"), y("an")),
        "address_length_diff": F.abs(F.length(x("address")) - F.length(y("address"))).cast("double"),
        "country_exact_match": sets.flag((x("country") != "") & (x("country") == y("country"))),
        "country_missing_either": sets.flag((x("country") == "") | (y("country") == "")),
        "is_source2": sets.flag(F.startswith(y("entity_id"), F.lit("S2"))),
        "is_source3": sets.flag(F.startswith(y("entity_id"), F.lit("S3"))),
    }


def joined(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """pairs (s1_id, target_id) with the structs a and b of their prepared entities; pairs with an unknown side go."""
    return _joined(pairs, prepared(left), prepared(right))


def _joined(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    a = left.select(F.col("entity_id").alias("s1_id"), F.struct("*").alias("a"))
    b = right.select(F.col("entity_id").alias("target_id"), F.struct("*").alias("b"))
    return pairs.join(a, "s1_id").join(b, "target_id")


def with_vectors(left: DataFrame, right: DataFrame, provider: embedding.Provider | None) -> tuple[DataFrame, DataFrame, Column]:
    """Prepared entities with their vectors, and the similarity of the structs a and b. Vectors are made once for each entity
    and travel with it: the offline ones as counts of the trigrams that occur; those of a provider by distinct text."""
    line = N.entity_text(*(F.col(c) for c in ("name", "address", "country")))
    left, right = left.withColumn("text", line), right.withColumn("text", line)
    if provider is not None and provider.available():
        vectors = provider.vectors(left.select("text").union(right.select("text")))
        if not provider.failed:
            left, right = (x.join(vectors, "text", "left").drop("text") for x in (left, right))
            return left, right, F.coalesce(embedding.cosine(F.col("a.vector"), F.col("b.vector")), F.lit(0.0))
    size = provider.size if provider is not None else embedding.DEFAULT.embedding
    left, right = (embedding.with_counts(x, F.col("text"), size).drop("text") for x in (left, right))
    left = left.withColumn("grams", embedding.packed(F.col("grams")))
    right = right.withColumn("placed", embedding.by_place(F.col("grams"))).drop("grams")
    return left, right, embedding.counted_cosine(F.col("a.grams"), F.col("a.norm"), F.col("b.placed"), F.col("b.norm"))


def pair_features(pairs: DataFrame, left: DataFrame, right: DataFrame, semantic: bool = True, provider: embedding.Provider | None = None) -> DataFrame:
    """Adds the features to pairs; left and right are (entity_id, name, address, country) with one row for each id."""
    a, b, similarity = prepared(left), prepared(right), F.lit(0.0)
    if semantic:
        a, b, similarity = with_vectors(a, b, provider)
    return _joined(pairs, a, b).select(*pairs.columns, *(c.alias(n) for n, c in feature_columns().items()), similarity.alias("semantic_similarity"))


def rule_score() -> Column:
    """A fixed blend of features, for use without a model."""
    weights = {"name_token_jaccard": 0.25, "name_char_3gram_jaccard": 0.25, "name_token_overlap": 0.1, "exact_name_match": 0.1, "address_token_jaccard": 0.1, "address_numeric_match": 0.1, "country_exact_match": 0.1}
    out = F.lit(0.0)
    for name, w in weights.items():
        out = out + F.lit(w) * F.col(name)
    return F.round(out, 6)
