"""One query for each operator, over the directory of kindred.sources.views, and DuckDB's SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.config import DEFAULT
from kindred.functions import embedding
from kindred.functions import normalize as N
from kindred.operators import blocking, cleaning, metrics, model, pairs, submission
from kindred.operators.features import FEATURES, feature_columns, joined, pair_features, rule_score
from kindred.sources import tables, views

#: Caps that bite on small tables.
TIGHT = replace(DEFAULT, cap=20, cap_number=5, top=5)
Query = Callable[[SparkSession, str], DataFrame]


class Directory:
    """The tables that queries start from."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.raw = views.entities(spark, sf_dir)
        self.clean = cleaning.clean_table(self.raw)
        self.s1 = views.source(self.clean, 1)
        self.targets = blocking.union_targets(views.source(self.clean, 2), views.source(self.clean, 3))
        self.truth = tables.truth_pairs(views.truth(self.raw))
        self.spine = self.s1.select(F.col("entity_id").alias("s1_id"))

    @property
    def left(self) -> DataFrame:
        return self.s1.select("entity_id", F.col("business_name_clean").alias("name"), F.col("business_address_clean").alias("address"), F.col("country_clean").alias("country"))

    @property
    def right(self) -> DataFrame:
        return blocking.attributes(self.targets)

    def found(self, settings=DEFAULT) -> DataFrame:
        return blocking.candidates(self.s1, self.targets, settings)

    def scored(self) -> DataFrame:
        return self.rule(self.found())

    def rule(self, found: DataFrame) -> DataFrame:
        rows = joined(found, self.left, self.right)
        return rows.select("s1_id", "target_id", "rank", *(c.alias(n) for n, c in feature_columns().items())).withColumn("score", rule_score())


def _columns(*names: str) -> Query:
    def run(spark, sf_dir):
        return Directory(spark, sf_dir).clean.select("entity_id", *names)

    return run


def _keys(kind: str) -> Query:
    def run(spark, sf_dir):
        return blocking.keys(Directory(spark, sf_dir).clean, (kind,)).select("entity_id", "place", "key")

    return run


def _features(names: tuple[str, ...]) -> Query:
    def run(spark, sf_dir):
        d = Directory(spark, sf_dir)
        made = joined(d.found().select("s1_id", "target_id"), d.left, d.right)
        own = feature_columns()
        return made.select("s1_id", "target_id", *(F.round(own[n], 6).alias(n) for n in names))

    return run


def numeric_tokens(spark, sf_dir):
    d = Directory(spark, sf_dir)
    return d.clean.select("entity_id", F.array_join(N.number_tokens(F.col("business_address_clean")), " ").alias("numbers"))


def char_ngrams(spark, sf_dir):
    d, name = Directory(spark, sf_dir), F.col("business_name_clean")
    return d.clean.select("entity_id", F.size(N.ngrams(name, 3)).cast("long").alias("n_grams"), F.array_join(F.array_sort(N.ngram_set(name, 3)), "/").alias("grams"))


def clean_table(spark, sf_dir):
    rows = Directory(spark, sf_dir).clean
    return rows.select("entity_id", "business_name", "business_name_clean", "business_address_clean", "country_clean", F.array_join("name_tokens", " ").alias("name_tokens"), F.col("name_length").cast("long").alias("name_length"), F.col("address_length").cast("long").alias("address_length"))


def entity_text(spark, sf_dir):
    line = N.entity_text(*(F.col(f"business_{c}_clean" if c != "country" else "country_clean") for c in ("name", "address", "country")))
    return Directory(spark, sf_dir).clean.select("entity_id", line.alias("entity_text"))


def union_targets(spark, sf_dir):
    return Directory(spark, sf_dir).targets.select("src_rank", "ord", "entity_id", "business_name_clean")


def ground_truth_long(spark, sf_dir):
    return Directory(spark, sf_dir).truth


def sample_s1(spark, sf_dir):
    return pairs.sample(Directory(spark, sf_dir).s1, 100).select("entity_id")


def semi_join_sample(spark, sf_dir):
    d = Directory(spark, sf_dir)
    return d.truth.withColumnRenamed("s1_id", "entity_id").transform(pairs.of_sample, pairs.sample(d.s1, 100))


def group_split(spark, sf_dir):
    return pairs.split(Directory(spark, sf_dir).s1).select("entity_id", "part")


def postings_capped(spark, sf_dir):
    return blocking.postings(Directory(spark, sf_dir).targets, TIGHT)


def target_attributes(spark, sf_dir):
    return Directory(spark, sf_dir).right


def candidate_scores(spark, sf_dir):
    d = Directory(spark, sf_dir)
    return blocking.hits(d.s1, blocking.postings(d.targets)).select("s1_id", "target_id", "score")


def country_filter(spark, sf_dir):
    d = Directory(spark, sf_dir)
    return blocking.compatible(blocking.hits(d.s1, blocking.postings(d.targets)), d.s1, d.right).select("s1_id", "target_id", "score")


def candidates_topk(spark, sf_dir):
    return Directory(spark, sf_dir).found()


def candidates_topk_tight(spark, sf_dir):
    return Directory(spark, sf_dir).found(TIGHT)


def candidates_all(spark, sf_dir):
    d = Directory(spark, sf_dir)
    return tables.id_lists(d.s1, d.found(), "candidate_entity_ids")


def candidate_recall(spark, sf_dir):
    d = Directory(spark, sf_dir)
    return blocking.candidate_recall(d.s1, d.found(), d.truth)


def feat_all(spark, sf_dir):
    d = Directory(spark, sf_dir)
    made = pair_features(d.found().select("s1_id", "target_id"), d.left, d.right)
    return made.select("s1_id", "target_id", *(F.round(n, 6).alias(n) for n in FEATURES))


def embed_offline(spark, sf_dir):
    d = Directory(spark, sf_dir)
    texts = d.left.select(N.entity_text(F.col("name"), F.col("address"), F.col("country")).alias("text"))
    made = embedding.embed(texts).select("text", F.posexplode("vector").alias("bucket", "value")).filter("value > 0")
    return made.select("text", F.col("bucket").cast("long").alias("bucket"), F.round("value", 6).alias("value"))


def cosine_pairs(spark, sf_dir):
    d = Directory(spark, sf_dir)
    made = pair_features(d.found().select("s1_id", "target_id"), d.left, d.right)
    return made.select("s1_id", "target_id", F.round("semantic_similarity", 6).alias("semantic_similarity"))


def pairs_positive(spark, sf_dir):
    d = Directory(spark, sf_dir)
    return pairs.positives(d.truth, d.targets)


def pairs_hard_negative(spark, sf_dir):
    d = Directory(spark, sf_dir)
    return pairs.hard_negatives(d.found(), d.truth, 10)


def _training(mode: str) -> Query:
    def run(spark, sf_dir):
        d = Directory(spark, sf_dir)
        return pairs.training_pairs(d.found(), d.truth, d.targets, 10, mode)

    return run


def rule_scores(spark, sf_dir):
    return Directory(spark, sf_dir).scored().select("s1_id", "target_id", "rank", "score")


def match_output(spark, sf_dir):
    d = Directory(spark, sf_dir)
    return tables.id_lists(d.s1, metrics.matches(d.scored(), 0.65), "matched_entity_ids")


def entity_fbeta(spark, sf_dir):
    d = Directory(spark, sf_dir)
    rows = metrics.entity_scores(d.spine, d.truth, metrics.matches(d.scored(), 0.65))
    return rows.select("s1_id", "n_true", "n_predicted", "n_both", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f")))


def macro_metrics(spark, sf_dir):
    d = Directory(spark, sf_dir)
    return metrics.macro(metrics.entity_scores(d.spine, d.truth, metrics.matches(d.scored(), 0.65)))


def threshold_sweep(spark, sf_dir):
    d = Directory(spark, sf_dir)
    return metrics.threshold_sweep(d.spine, d.truth, d.scored())


def best_threshold(spark, sf_dir):
    return metrics.best_threshold(threshold_sweep(spark, sf_dir))


def profile_nulls(spark, sf_dir):
    return cleaning.profile(Directory(spark, sf_dir).raw.drop("truth_key"))


def profile_duplicates(spark, sf_dir):
    return cleaning.duplicate_keys(Directory(spark, sf_dir).raw, "business_address")


def profile_top_countries(spark, sf_dir):
    return cleaning.top_countries(Directory(spark, sf_dir).raw)


def profile_shape(spark, sf_dir):
    return cleaning.shape(Directory(spark, sf_dir).raw.drop("truth_key"))


def profile_first_rows(spark, sf_dir):
    return cleaning.first_rows(Directory(spark, sf_dir).raw).select("entity_id", "business_name", "business_address", "country")


def validate_clean(spark, sf_dir):
    d = Directory(spark, sf_dir)
    return cleaning.check_clean(d.raw, d.clean)


def validate_submission(spark, sf_dir):
    """Matches from candidates of one setting against the candidates of a tighter one, so that some are missing there."""
    d = Directory(spark, sf_dir)
    matched = tables.id_lists(d.s1, metrics.matches(d.scored(), 0.3), "matched_entity_ids")
    return submission.validate(matched, tables.id_lists(d.s1, d.found(TIGHT), "candidate_entity_ids"), d.s1)


def submission_summary(spark, sf_dir):
    return submission.summary(match_output(spark, sf_dir))


def gbt_match(spark, sf_dir):
    """Probabilities by a model of the default settings, trained on the pairs that blocking finds. Those are among the pairs that
    get a probability, so candidates and features are made once, and stay on disk: the result reads them."""
    d = Directory(spark, sf_dir)
    found = tables.kept(d.found().select("s1_id", "target_id", "rank"))
    made = pairs.training_pairs(found, d.truth, d.targets, 10).select("s1_id", "target_id", "label").distinct()
    rows = tables.kept(pair_features(found.join(made, ["s1_id", "target_id"], "left"), d.left, d.right))
    trained = model.fit(rows.filter("label is not null"), DEFAULT)
    return model.predict(trained, rows).select("s1_id", "target_id", F.round("score", 6).alias("score"))


NAME = ("exact_name_match", "first_word_match", "name_token_jaccard", "name_token_overlap", "name_token_dice")
CHARS = ("name_char_3gram_jaccard", "name_char_4gram_jaccard", "name_char_overlap_ratio")
LENGTHS = ("name_length_diff", "name_length_ratio", "name_prefix_match_3", "name_prefix_match_5")
ADDRESS = ("address_token_jaccard", "address_token_overlap", "address_char_3gram_jaccard", "address_numeric_match", "address_numeric_jaccard", "address_length_diff")
SOURCE = ("country_exact_match", "country_missing_either", "is_source2", "is_source3")

QUERIES: dict[str, Query] = {
    "match_output": match_output,
    "normalize_name": _columns("business_name_clean"),
    "normalize_address": _columns("business_address_clean"),
    "normalize_country": _columns("country_clean"),
    "name_tokens": lambda spark, sf_dir: Directory(spark, sf_dir).clean.select("entity_id", F.posexplode("name_tokens").alias("place", "token")),
    "clean_table": clean_table,
    "numeric_tokens": numeric_tokens,
    "char_ngrams": char_ngrams,
    "entity_text": entity_text,
    "union_targets": union_targets,
    "ground_truth_long": ground_truth_long,
    "sample_s1": sample_s1,
    "semi_join_sample": semi_join_sample,
    "group_split": group_split,
    "keys_exact": _keys("exact"),
    "keys_bigram": _keys("bigram"),
    "keys_first_word": _keys("first"),
    "keys_salient": _keys("salient"),
    "keys_address_num": _keys("number"),
    "postings_capped": postings_capped,
    "target_attributes": target_attributes,
    "candidate_scores": candidate_scores,
    "country_filter": country_filter,
    "candidates_topk": candidates_topk,
    "candidates_topk_tight": candidates_topk_tight,
    "candidates_all": candidates_all,
    "candidate_recall": candidate_recall,
    "feat_name": _features(NAME),
    "feat_char": _features(CHARS),
    "feat_length_prefix": _features(LENGTHS),
    "feat_containment": _features(("name_token_containment",)),
    "feat_address": _features(ADDRESS),
    "feat_country_source": _features(SOURCE),
    "feat_all": feat_all,
    "embed_offline": embed_offline,
    "cosine_pairs": cosine_pairs,
    "pairs_positive": pairs_positive,
    "pairs_hard_negative": pairs_hard_negative,
    "training_pairs": _training("blocked"),
    "training_pairs_injected": _training("injected"),
    "rule_score": rule_scores,
    "entity_fbeta": entity_fbeta,
    "macro_metrics": macro_metrics,
    "threshold_sweep": threshold_sweep,
    "best_threshold": best_threshold,
    "profile_nulls": profile_nulls,
    "profile_duplicates": profile_duplicates,
    "profile_top_countries": profile_top_countries,
    "profile_shape": profile_shape,
    "profile_first_rows": profile_first_rows,
    "validate_clean": validate_clean,
    "validate_submission": validate_submission,
    "submission_summary": submission_summary,
    "gbt_match": gbt_match,
}


# ---------------------------------------------------------------- the same in SQL


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_clean(column: str, words: dict[str, str], edges: str) -> str:
    cases = " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in words.items())
    parts = f"list_filter(regexp_split_to_array(replace(lower(coalesce({column}, '')), '&', ' and '), {_q(N.WHITE)}), lambda t: t <> '')"
    spelled = f"array_to_string(list_transform({parts}, lambda t: CASE trim(t, {_q(edges)}) {cases} ELSE t END), ' ')"
    return f"trim(regexp_replace(regexp_replace({spelled}, {_q(N.PUNCTUATION)}, ' ', 'g'), {_q(N.WHITE)}, ' ', 'g'))"


def _sql_grams(column: str, n: int) -> str:
    return f"CASE WHEN length({column}) < {n} THEN [] ELSE list_transform(range(1, length({column}) - {n} + 2), lambda i: substr({column}, i, {n})) END"


GENERIC = ", ".join(map(_q, blocking.GENERIC))


def _ctes(cap: int = DEFAULT.cap, cap_number: int = DEFAULT.cap_number, top: int = DEFAULT.top, suffix: str = "") -> dict[str, str]:
    """Named parts, in order; a query takes those it needs with all before them that they need."""
    s = suffix
    weights = " ".join(f"WHEN {_q(k)} THEN {w}" for k, w in DEFAULT.weights)
    return {
        f"postings{s}": f"""SELECT kind, key, entity_id, rn FROM (
            SELECT *, row_number() OVER (PARTITION BY kind, key ORDER BY src, ord, place) AS rn FROM keys WHERE src > 1)
            WHERE rn <= CASE WHEN kind = 'number' THEN {cap_number} ELSE {cap} END""",
        f"hits{s}": f"""SELECT k.entity_id AS s1_id, p.entity_id AS target_id, CAST(sum(CASE k.kind {weights} END) AS BIGINT) AS score,
            min((k.prio * 1000 + k.place) * 1000 + p.rn) AS first_hit
            FROM keys k JOIN postings{s} p ON k.kind = p.kind AND k.key = p.key WHERE k.src = 1 GROUP BY 1, 2""",
        f"fitting{s}": f"""SELECT h.* FROM hits{s} h JOIN clean a ON a.entity_id = h.s1_id JOIN clean b ON b.entity_id = h.target_id
            WHERE a.ctry = '' OR b.ctry = '' OR a.ctry = b.ctry""",
        f"cand{s}": f"""SELECT s1_id, target_id, score, CAST(rank AS INTEGER) AS rank FROM (
            SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY score DESC, first_hit) AS rank FROM fitting{s}) WHERE rank <= {top}""",
    }


def _both(expression: str) -> tuple[str, str]:
    return expression.format(s="a"), expression.format(s="b")


def _set(kind: str, how: str) -> str:
    a, b = f"a.{kind}", f"b.{kind}"
    both = f"len(list_intersect({a}, {b}))"
    below = {"jaccard": f"(len({a}) + len({b}) - {both})", "overlap": f"least(len({a}), len({b}))", "dice": f"(len({a}) + len({b}))"}[how]
    return f"coalesce(CAST({'2 * ' if how == 'dice' else ''}{both} AS DOUBLE) / nullif({below}, 0), 0.0::DOUBLE)"


def _flag(condition: str) -> str:
    return f"CASE WHEN {condition} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"


SQL_FEATURES = {
    "exact_name_match": _flag("a.name <> '' AND a.name = b.name"),
    "first_word_match": _flag("a.w[1] = b.w[1]"),
    "name_token_jaccard": _set("nt", "jaccard"),
    "name_token_overlap": _set("nt", "overlap"),
    "name_token_dice": _set("nt", "dice"),
    "name_char_3gram_jaccard": _set("n3", "jaccard"),
    "name_char_4gram_jaccard": _set("n4", "jaccard"),
    "name_length_diff": "CAST(abs(length(a.name) - length(b.name)) AS DOUBLE)",
    "name_length_ratio": "CAST(least(length(a.name), length(b.name)) AS DOUBLE) / greatest(length(a.name), length(b.name), 1)",
    "name_prefix_match_3": _flag("length(a.name) >= 3 AND length(b.name) >= 3 AND left(a.name, 3) = left(b.name, 3)"),
    "name_prefix_match_5": _flag("length(a.name) >= 5 AND length(b.name) >= 5 AND left(a.name, 5) = left(b.name, 5)"),
    "name_char_overlap_ratio": _set("n1", "jaccard"),
    "name_token_containment": _flag("len(a.nt) > 0 AND (list_has_all(b.nt, a.nt) OR list_has_all(a.nt, b.nt))"),
    "address_token_jaccard": _set("at", "jaccard"),
    "address_token_overlap": _set("at", "overlap"),
    "address_char_3gram_jaccard": _set("a3", "jaccard"),
    "address_numeric_match": _flag("len(list_intersect(a.an, b.an)) > 0"),
    "address_numeric_jaccard": _set("an", "jaccard"),
    "address_length_diff": "CAST(abs(length(a.address) - length(b.address)) AS DOUBLE)",
    "country_exact_match": _flag("a.ctry <> '' AND a.ctry = b.ctry"),
    "country_missing_either": _flag("a.ctry = '' OR b.ctry = ''"),
    "is_source2": _flag("b.entity_id LIKE 'S2%'"),
    "is_source3": _flag("b.entity_id LIKE 'S3%'"),
}
RULE = "+ ".join(f"{w} * f.{n}" for n, w in (("name_token_jaccard", "0.25::DOUBLE"), ("name_char_3gram_jaccard", "0.25::DOUBLE"), ("name_token_overlap", "0.1::DOUBLE"), ("exact_name_match", "0.1::DOUBLE"), ("address_token_jaccard", "0.1::DOUBLE"), ("address_numeric_match", "0.1::DOUBLE"), ("country_exact_match", "0.1::DOUBLE")))


def _f_beta(true: str, predicted: str, both: str) -> tuple[str, str, str]:
    p, r = f"coalesce({both}::DOUBLE / nullif({predicted}, 0), 0.0::DOUBLE)", f"coalesce({both}::DOUBLE / nullif({true}, 0), 0.0::DOUBLE)"
    f = f"coalesce(1.25 * {p} * {r} / nullif(0.25 * {p} + {r}, 0), 0.0::DOUBLE)"
    return tuple(f"CASE WHEN {true} = 0 AND {predicted} = 0 THEN 1.0::DOUBLE ELSE {x} END" for x in (p, r, f))


_P, _R, _F = _f_beta("n_true", "n_predicted", "n_both")
PARTS = {
    "er": views.ENTITIES.format(text="VARCHAR", table="documents"),
    "clean": f"""SELECT ord, entity_id, CAST(substr(entity_id, 2, 1) AS INTEGER) AS src, business_name, business_address, country, truth_key,
        {_sql_clean('business_name', N.NAME_WORDS, N.NAME_EDGES)} AS name, {_sql_clean('business_address', N.ADDRESS_WORDS, N.ADDRESS_EDGES)} AS address,
        lower(trim(coalesce(country, ''))) AS ctry FROM er""",
    "words": r"SELECT *, CASE WHEN name = '' THEN [] ELSE string_split(name, ' ') END AS w, regexp_extract_all(address, '\b\d{2,}\b') AS nums FROM clean",
    "long_words": f"""SELECT ord, entity_id, src, ctry, t, row_number() OVER (PARTITION BY ord ORDER BY length(t) DESC, i) - 1 AS place
        FROM (SELECT ord, entity_id, src, ctry, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS i FROM words) WHERE length(t) >= 4 AND t NOT IN ({GENERIC})""",
    "keys": f"""SELECT ord, entity_id, src, ctry, 'exact' AS kind, 0 AS prio, 0 AS place, name AS key FROM words WHERE name <> ''
        UNION ALL SELECT ord, entity_id, src, ctry, 'bigram', 1, i, w[i + 1] || '_' || w[i + 2] FROM (
            SELECT *, unnest(range(0, least(3, len(w) - 1))) AS i FROM words WHERE len(w) > 1)
        UNION ALL SELECT ord, entity_id, src, ctry, 'first', 2, 0, w[1] FROM words WHERE length(w[1]) >= 3 AND w[1] NOT IN ({GENERIC})
        UNION ALL SELECT ord, entity_id, src, ctry, 'salient', 3, place, t FROM long_words WHERE place < 3
        UNION ALL SELECT ord, entity_id, src, ctry, 'number', 4, i, CASE WHEN ctry = '' THEN '' ELSE ctry || '|' END || nums[i + 1] FROM (
            SELECT *, unnest(range(0, least(2, len(nums)))) AS i FROM words) WHERE i = 0 OR nums[2] <> nums[1]""",
    **_ctes(),
    **_ctes(TIGHT.cap, TIGHT.cap_number, TIGHT.top, "_tight"),
    "truth": """SELECT a.entity_id AS s1_id, b.entity_id AS target_id, b.ord AS place FROM clean a JOIN clean b ON a.truth_key = b.truth_key
        WHERE a.src = 1 AND b.src > 1""",
    "sets": f"""SELECT entity_id, name, address, ctry, w, list_distinct(w) AS nt, list_distinct({_sql_grams('name', 3)}) AS n3, list_distinct({_sql_grams('name', 4)}) AS n4,
        list_distinct({_sql_grams('name', 1)}) AS n1, CASE WHEN address = '' THEN [] ELSE list_distinct(string_split(address, ' ')) END AS at,
        list_distinct({_sql_grams('address', 3)}) AS a3, list_distinct(nums) AS an FROM words""",
    "features": "SELECT c.s1_id, c.target_id, c.rank, " + ", ".join(f"{x} AS {n}" for n, x in SQL_FEATURES.items()) + " FROM cand c JOIN sets a ON a.entity_id = c.s1_id JOIN sets b ON b.entity_id = c.target_id",
    "scored": f"SELECT f.s1_id, f.target_id, f.rank, round({RULE}, 6) AS score FROM features f",
    "lines": "SELECT entity_id, src, 'Business: ' || name || ' | Address: ' || address || ' | Country: ' || ctry AS line FROM clean",
    "grams": f"""SELECT line, CAST('0x' || substr(md5(g), 1, 7) AS BIGINT) % 256 AS bucket, CAST(count(*) AS DOUBLE) AS n FROM (
        SELECT line, unnest({_sql_grams('low', 3)}) AS g FROM (SELECT DISTINCT line, lower(line) AS low FROM lines)) GROUP BY ALL""",
    "norms": "SELECT line, sqrt(sum(n * n)) AS norm FROM grams GROUP BY line",
    "likeness": """SELECT c.s1_id, c.target_id, least(greatest(coalesce(sum(u.n / nu.norm * (v.n / nv.norm)), 0.0::DOUBLE), 0), 1) AS semantic_similarity FROM cand c
        JOIN lines a ON a.entity_id = c.s1_id JOIN lines b ON b.entity_id = c.target_id JOIN norms nu ON nu.line = a.line JOIN norms nv ON nv.line = b.line
        JOIN grams u ON u.line = a.line LEFT JOIN grams v ON v.line = b.line AND v.bucket = u.bucket GROUP BY 1, 2""",
    "predicted": "SELECT s1_id, target_id, rank FROM scored WHERE score >= 0.65",
    "counts": """SELECT entity_id AS s1_id, CAST(coalesce(t.n, 0) AS BIGINT) AS n_true, CAST(coalesce(p.n, 0) AS BIGINT) AS n_predicted, CAST(coalesce(b.n, 0) AS BIGINT) AS n_both
        FROM clean c LEFT JOIN (SELECT s1_id, count(*) AS n FROM truth GROUP BY 1) t ON t.s1_id = c.entity_id
        LEFT JOIN (SELECT s1_id, count(*) AS n FROM predicted GROUP BY 1) p ON p.s1_id = c.entity_id
        LEFT JOIN (SELECT s1_id, count(*) AS n FROM predicted JOIN truth USING (s1_id, target_id) GROUP BY 1) b ON b.s1_id = c.entity_id WHERE c.src = 1""",
    "grid": "SELECT unnest(range(10, 95, 2)) / 100.0::DOUBLE AS threshold",
    "steps": """SELECT g.threshold, c.entity_id AS s1_id, count(DISTINCT t.target_id) AS n_true FROM grid g, clean c LEFT JOIN truth t ON t.s1_id = c.entity_id WHERE c.src = 1 GROUP BY 1, 2""",
    "taken": """SELECT g.threshold, s.s1_id, count(*) AS n_predicted, count(t.target_id) AS n_both FROM grid g JOIN scored s ON s.score >= g.threshold
        LEFT JOIN truth t ON t.s1_id = s.s1_id AND t.target_id = s.target_id GROUP BY 1, 2""",
    "sweep": f"""SELECT threshold, round(avg({_P}), 6) AS macro_precision, round(avg({_R}), 6) AS macro_recall, round(avg({_F}), 6) AS macro_f, CAST(sum(n_predicted) AS BIGINT) AS total_predicted_matches
        FROM (SELECT s.threshold, n_true, coalesce(n_predicted, 0) AS n_predicted, coalesce(n_both, 0) AS n_both FROM steps s LEFT JOIN taken USING (threshold, s1_id)) GROUP BY 1""",
    "place": "SELECT entity_id, ord, CAST('0x' || substr(md5(entity_id || ':42'), 1, 15) AS BIGINT) AS h FROM clean WHERE src = 1",
}


def _with(select: str) -> str:
    """The select with the parts that it needs."""
    import re

    need, todo = set(), [select]
    while todo:
        text = todo.pop()
        for name in PARTS:
            if name not in need and re.search(rf"(?:FROM|JOIN|,)\s+{name}\b", text):
                need.add(name)
                todo.append(PARTS[name])
    if not need:
        return select
    return "WITH " + ",\n".join(f"{n} AS ({PARTS[n]})" for n in PARTS if n in need) + "\n" + select


def _lists(rows: str, name: str) -> str:
    return f"""SELECT c.ord, c.entity_id AS source1_entity_id, coalesce(string_agg(x.target_id, ',' ORDER BY x.rank), '') AS {name}
        FROM clean c LEFT JOIN {rows} x ON x.s1_id = c.entity_id WHERE c.src = 1 GROUP BY 1, 2"""


def _sql_features(names) -> str:
    return "SELECT s1_id, target_id, " + ", ".join(f"round({n}, 6) AS {n}" for n in names) + " FROM features"


def _sql_keys(kind: str) -> str:
    return f"SELECT entity_id, CAST(place AS INTEGER) AS place, key FROM keys WHERE kind = '{kind}'"


def _nulls() -> str:
    one = "SELECT '{0}' AS column_name, count(*) AS rows, count(*) - count({0}) AS nulls, round(100.0::DOUBLE * (count(*) - count({0})) / count(*), 6) AS null_percent FROM er"
    return " UNION ALL ".join(one.format(c) for c in ("entity_id", "business_name", "business_address", "country"))


_TRAIN = """SELECT DISTINCT s1_id, target_id, 1 AS label, '{0}' AS mode FROM truth {1} UNION ALL
    SELECT s1_id, target_id, 0, '{0}' FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY rank) AS n FROM cand ANTI JOIN truth USING (s1_id, target_id)) WHERE n <= 10"""

SQL = {
    "match_output": _lists("predicted", "matched_entity_ids"),
    "normalize_name": "SELECT entity_id, name AS business_name_clean FROM clean",
    "normalize_address": "SELECT entity_id, address AS business_address_clean FROM clean",
    "normalize_country": "SELECT entity_id, ctry AS country_clean FROM clean",
    "name_tokens": "SELECT entity_id, CAST(unnest(range(0, len(w))) AS INTEGER) AS place, unnest(w) AS token FROM words",
    "clean_table": """SELECT entity_id, business_name, name AS business_name_clean, address AS business_address_clean, ctry AS country_clean, array_to_string(w, ' ') AS name_tokens,
        length(name) AS name_length, length(address) AS address_length FROM words""",
    "numeric_tokens": "SELECT entity_id, array_to_string(nums, ' ') AS numbers FROM words",
    "char_ngrams": f"SELECT entity_id, len({_sql_grams('name', 3)}) AS n_grams, array_to_string(list_sort(list_distinct({_sql_grams('name', 3)})), '/') AS grams FROM clean",
    "entity_text": "SELECT entity_id, line AS entity_text FROM lines",
    "union_targets": "SELECT CAST(src - 2 AS INTEGER) AS src_rank, ord, entity_id, name AS business_name_clean FROM clean WHERE src > 1",
    "ground_truth_long": "SELECT s1_id, target_id FROM truth",
    "sample_s1": "SELECT entity_id FROM place ORDER BY h, ord LIMIT 100",
    "semi_join_sample": "SELECT s1_id AS entity_id, target_id FROM truth WHERE s1_id IN (SELECT entity_id FROM place ORDER BY h, ord LIMIT 100)",
    "group_split": "SELECT entity_id, CASE WHEN h % 10 < 2 THEN 'valid' ELSE 'train' END AS part FROM place",
    "keys_exact": _sql_keys("exact"),
    "keys_bigram": _sql_keys("bigram"),
    "keys_first_word": _sql_keys("first"),
    "keys_salient": _sql_keys("salient"),
    "keys_address_num": _sql_keys("number"),
    "postings_capped": "SELECT kind, key, entity_id, CAST(rn AS INTEGER) AS rn FROM postings_tight",
    "target_attributes": "SELECT entity_id, name, address, ctry AS country FROM clean WHERE src > 1",
    "candidate_scores": "SELECT s1_id, target_id, score FROM hits",
    "country_filter": "SELECT s1_id, target_id, score FROM fitting",
    "candidates_topk": "SELECT s1_id, target_id, score, rank FROM cand",
    "candidates_topk_tight": "SELECT s1_id, target_id, score, rank FROM cand_tight",
    "candidates_all": _lists("cand", "candidate_entity_ids"),
    "candidate_recall": """SELECT round(avg(n), 6) AS avg_candidates, median(n) AS median_candidates, CAST(max(n) AS BIGINT) AS max_candidates,
        round(100 * avg(CASE WHEN n = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS zero_percent, CAST(sum(n) AS BIGINT) AS total_pairs,
        (SELECT count(*) FROM truth) AS true_pairs, (SELECT count(*) FROM truth SEMI JOIN cand USING (s1_id, target_id)) AS found_pairs,
        round((SELECT count(*) FROM truth SEMI JOIN cand USING (s1_id, target_id))::DOUBLE / (SELECT count(*) FROM truth), 6) AS recall
        FROM (SELECT c.entity_id, count(x.target_id) AS n FROM clean c LEFT JOIN cand x ON x.s1_id = c.entity_id WHERE c.src = 1 GROUP BY 1)""",
    "feat_name": _sql_features(NAME),
    "feat_char": _sql_features(CHARS),
    "feat_length_prefix": _sql_features(LENGTHS),
    "feat_containment": _sql_features(("name_token_containment",)),
    "feat_address": _sql_features(ADDRESS),
    "feat_country_source": _sql_features(SOURCE),
    "feat_all": "SELECT f.s1_id, f.target_id, " + ", ".join(f"round({n}, 6) AS {n}" for n in FEATURES) + " FROM features f JOIN likeness s ON s.s1_id = f.s1_id AND s.target_id = f.target_id",
    "embed_offline": "SELECT g.line AS text, bucket, round(n / norm, 6) AS value FROM grams g JOIN norms USING (line) WHERE g.line IN (SELECT line FROM lines WHERE src = 1)",
    "cosine_pairs": "SELECT s1_id, target_id, round(semantic_similarity, 6) AS semantic_similarity FROM likeness",
    "pairs_positive": "SELECT s1_id, target_id, 1 AS label FROM truth",
    "pairs_hard_negative": """SELECT s1_id, target_id, 0 AS label, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY rank) AS n FROM cand ANTI JOIN truth USING (s1_id, target_id)) WHERE n <= 10""",
    "training_pairs": _TRAIN.format("blocked", "SEMI JOIN cand USING (s1_id, target_id)"),
    "training_pairs_injected": _TRAIN.format("injected", ""),
    "rule_score": "SELECT s1_id, target_id, rank, score FROM scored",
    "entity_fbeta": f"SELECT s1_id, n_true, n_predicted, n_both, round({_P}, 6) AS precision, round({_R}, 6) AS recall, round({_F}, 6) AS f FROM counts",
    "macro_metrics": f"""SELECT round(avg({_P}), 6) AS macro_precision, round(avg({_R}), 6) AS macro_recall, round(avg({_F}), 6) AS macro_f, CAST(sum(n_predicted) AS BIGINT) AS total_predicted_matches,
        count(*) FILTER (n_predicted = 0) AS zero_prediction_s1_count, count(*) FILTER (n_true = 0) AS singleton_s1_count,
        count(*) FILTER (n_predicted = 0 AND n_true = 0) AS correct_singleton_count, count(*) AS total_evaluated_s1, 'blocked' AS pairs_mode FROM counts""",
    "threshold_sweep": "SELECT *, 'blocked' AS pairs_mode FROM sweep",
    "best_threshold": "SELECT *, 'blocked' AS pairs_mode FROM sweep ORDER BY macro_f DESC, threshold LIMIT 1",
    "profile_shape": "SELECT count(*) AS rows, CAST(4 AS BIGINT) AS columns, 'entity_id,business_name,business_address,country' AS names FROM er",
    "profile_first_rows": "SELECT entity_id, business_name, business_address, country FROM er ORDER BY ord LIMIT 3",
    "profile_nulls": _nulls(),
    "profile_duplicates": "SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS distinct_keys, CAST(sum(n) - count(*) AS BIGINT) AS duplicates FROM (SELECT business_address, count(*) AS n FROM er GROUP BY 1)",
    "profile_top_countries": "SELECT country, count(*) AS rows FROM er GROUP BY 1 ORDER BY 2 DESC, 1 NULLS LAST LIMIT 5",
    "validate_clean": "SELECT unnest(['row_count', 'entity_ids', 'business_name', 'business_address', 'country', 'countries', 'added_columns']) AS check_name, CAST(0 AS BIGINT) AS violations FROM range(1)",
    "validate_submission": """SELECT * FROM (VALUES ('candidate_row_count', CAST(0 AS BIGINT)), ('candidate_ids', 0), ('match_row_count', 0), ('match_ids', 0), ('repeated_ids', 0), ('first_source_ids', 0), ('foreign_ids', 0)) t(check_name, violations)
        UNION ALL SELECT 'not_candidates', count(*) FROM (SELECT s1_id, target_id FROM scored WHERE score >= 0.3) ANTI JOIN cand_tight USING (s1_id, target_id)""",
    "submission_summary": """SELECT count(*) AS rows, CAST(sum(n_predicted) AS BIGINT) AS total_matches, count(*) FILTER (n_predicted = 0) AS zero_matches,
        round(100.0::DOUBLE * count(*) FILTER (n_predicted = 0) / count(*), 6) AS zero_percent FROM counts""",
}


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {name: _with(select) for name, select in SQL.items()}
