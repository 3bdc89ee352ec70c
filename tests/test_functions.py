import hashlib
import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kindred.functions import embedding, sets
from kindred.functions import normalize as N
from kindred.operators.features import pair_features

NAMES = {
    "Sharma Sweets Pvt. Ltd.": "sharma sweets private limited",
    "Acme pvt.ltd": "acme pvt ltd",
    "acme pvt ltd": "acme private limited",
    "A&B Co.,": "a and b company",
    "L.L.C. Group": "l l c group",
    "-Inc- Foo": "incorporated foo",
    "  Café_Noir™  ": "café noir",
    "(co) x": "co x",
    "Foo – Bar Corp": "foo bar corporation",
    None: "",
    " x y\x1cz ": "x y z",
}
ADDRESSES = {
    "12, M.G. Rd., Apt. #4": "12 m g road apartment 4",
    "St. Louis, FL": "street louis floor",
    "#Ste 5/7": "suite 5 7",
    "1-2 Dr": "1 2 drive",
    "5 Ave/Rd": "5 ave rd",
    None: "",
}
NUMBERS = {"12 mg road 560001": ["12", "560001"], "7 a12 12a 12 34 12": ["12", "34", "12"], "": [], None: [], "٣٤ é12": ["٣٤"]}


def apply(spark, column, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.y for r in rows.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


@pytest.mark.parametrize(("column", "cases"), [(N.normalize_name, NAMES), (N.normalize_address, ADDRESSES), (N.number_tokens, NUMBERS)])
def test_golden(spark, column, cases):
    assert apply(spark, column, cases) == list(cases.values())


def test_country_tokens_and_windows(spark):
    assert apply(spark, N.normalize_country, [" US ", None, " India\n"]) == ["us", "", "india"]
    assert apply(spark, N.tokens, ["", None, "a b"]) == [[], [], ["a", "b"]]
    assert apply(spark, lambda c: N.ngrams(c, 3), ["", "ab", "abc", "aaaa", None]) == [[], [], ["abc"], ["aaa", "aaa"], []]
    assert apply(spark, lambda c: N.ngram_set(c, 3), ["aaaa"]) == [["aaa"]]
    assert apply(spark, lambda c: N.entity_text(c, F.lit(None), F.lit(" in ")), [" x "]) == ["Business: x | Address:  | Country: in"]


def test_lower_case_of_dotted_i(spark):
    assert apply(spark, N.normalize_name, ["İx"]) == ["İx".lower()]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.lists(st.sampled_from("abcdef"), max_size=5), st.lists(st.sampled_from("abcdef"), max_size=5)), min_size=1, max_size=20))
def test_overlaps(spark, pairs):
    rows = spark.createDataFrame([(i, sorted(set(a)), sorted(set(b))) for i, (a, b) in enumerate(pairs)], "i int, a array<string>, b array<string>")
    made = rows.select("i", sets.jaccard(F.col("a"), F.col("b")).alias("j"), sets.jaccard(F.col("b"), F.col("a")).alias("k"), sets.dice(F.col("a"), F.col("b")).alias("d"), sets.overlap(F.col("a"), F.col("b")).alias("o"))
    for r in made.collect():
        a, b = (set(x) for x in pairs[r.i])
        both = len(a & b)
        assert r.j == r.k and 0 <= r.j <= r.d <= 1
        assert r.j == (both / len(a | b) if a and b else 0)
        assert r.o == (both / min(len(a), len(b)) if a and b else 0)


def test_embedding(spark):
    texts = ["Sharma sweets", "sharma SWEETS", "ab", ""]
    rows = {r.text: list(r.vector) for r in embedding.embed(spark.createDataFrame([(t,) for t in [*texts, texts[0], None]], "text string")).collect()}
    assert set(rows) == set(texts)
    own = [0.0] * 256
    for i in range(11):
        own[int(hashlib.md5(b"sharma sweets"[i : i + 3]).hexdigest()[:7], 16) % 256] += 1
    norm = math.sqrt(sum(x * x for x in own))
    assert rows[texts[0]] == rows[texts[1]] == pytest.approx([x / norm for x in own])
    assert rows["ab"] == rows[""] == [0.0] * 256


ENTITIES = "entity_id string, name string, address string, country string"


def similarity(spark, provider):
    left = spark.createDataFrame([("S1-1", "sharma sweets", "", ""), ("S1-2", None, None, None)], ENTITIES)
    right = spark.createDataFrame([("S2-1", "sharma sweets", "", ""), ("S2-2", "other things", "", "")], ENTITIES)
    pairs = left.select(F.col("entity_id").alias("s1_id")).crossJoin(right.select(F.col("entity_id").alias("target_id")))
    return {(r.s1_id[-1], r.target_id[-1]): r.semantic_similarity for r in pair_features(pairs, left, right, provider=provider).collect()}


def offline(a, b):
    def vector(text):
        out = {}
        for i in range(len(text) - 2):
            k = int(hashlib.md5(text[i : i + 3].lower().encode()).hexdigest()[:7], 16) % 256
            out[k] = out.get(k, 0) + 1
        return out

    u, v = vector(a), vector(b)
    return sum(n * v.get(k, 0) for k, n in u.items()) / math.sqrt(sum(n * n for n in u.values()) * sum(n * n for n in v.values()))


LINE = "Business: {} | Address:  | Country: "


def test_offline_similarity(spark):
    got = similarity(spark, None)
    for (i, a) in (("1", "sharma sweets"), ("2", "")):
        for (j, b) in (("1", "sharma sweets"), ("2", "other things")):
            assert got[i, j] == pytest.approx(offline(LINE.format(a), LINE.format(b)))


def test_provider(spark):
    def connect():
        return lambda texts: [[1.0, 0.0] if "sharma" in t else [0.6, 0.8] for t in texts]

    got = similarity(spark, embedding.Provider(connect, size=2))
    assert got == pytest.approx({("1", "1"): 1.0, ("1", "2"): 0.6, ("2", "1"): 0.6, ("2", "2"): 1.0})


@pytest.mark.parametrize("kind", ["no client", "client fails", "call fails"])
def test_a_failing_provider_falls_back_for_good(spark, kind):
    def connect():
        if kind == "client fails":
            raise OSError("no route")

        def call(texts):
            raise TimeoutError("too late")

        return call if kind == "call fails" else None

    own = embedding.Provider(connect)
    if kind == "no client":
        assert similarity(spark, own) == similarity(spark, None)
    else:
        with pytest.warns(UserWarning, match="offline"):
            assert similarity(spark, own) == similarity(spark, None)
    own.connect = lambda: lambda texts: [[1.0] for _ in texts]  # it would work now, but isn't asked again
    assert not own.available() and similarity(spark, own) == similarity(spark, None)


def test_cached_vectors_are_not_asked_for_again(spark, tmp_path):
    cache = f"file://{tmp_path}/vectors"
    first = similarity(spark, embedding.Provider(lambda: lambda texts: [[float("sharma" in t), float("sharma" not in t)] for t in texts], cache))

    def connect():
        def call(texts):
            raise AssertionError(texts)

        return call

    again = embedding.Provider(connect, cache)
    assert similarity(spark, again) == first == pytest.approx({("1", "1"): 1.0, ("1", "2"): 0.0, ("2", "1"): 0.0, ("2", "2"): 1.0})
    assert not again.failed


def test_counts_by_place(spark):
    rows = embedding.with_counts(spark.createDataFrame([("aaaa bcd aaa",), ("ab",), (None,)], "t string"), F.col("t"), 16)
    got = rows.select("t", "grams", "norm", embedding.by_place(F.col("grams")).alias("p")).collect()
    for r in got:
        counts = {}
        for i in range(len(r.t or "") - 2):
            k = int(hashlib.md5(r.t[i : i + 3].encode()).hexdigest()[:7], 16) % 16
            counts[k] = counts.get(k, 0) + 1
        assert [(x.b, x.n) for x in r.grams] == sorted(counts.items()) and r.norm == pytest.approx(math.sqrt(sum(n * n for n in counts.values())))
        assert r.p == [counts.get(k, 0) for k in range(max(counts, default=-1) + 1)]
