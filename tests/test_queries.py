"""Each registered query against its SQL, and that the order of the input doesn't matter."""

import pytest
from pyspark.sql import functions as F

from kindred.config import DEFAULT
from kindred.plans import queries as Q
from tests.conftest import SMALL, plain


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_against_sql(name, same_rows):
    same_rows(Q.QUERIES[name], Q.oracle_sql()[name])


def test_every_query_has_sql_but_the_model():
    assert set(Q.QUERIES) - set(Q.SQL) == {"gbt_match"}


def test_the_model_takes_the_default_settings(spark, monkeypatch):
    class Seen(Exception):
        pass

    def fit(rows, settings=DEFAULT):
        raise Seen(settings)

    monkeypatch.setattr(Q.model, "fit", fit)
    with pytest.raises(Seen) as seen:
        Q.QUERIES["gbt_match"](spark, SMALL)
    assert seen.value.args == (DEFAULT,)


def test_registered():
    import __spark_entry__ as entry

    assert set(Q.QUERIES) <= set(entry.queries()) and set(Q.SQL) <= set(entry.oracle_sql())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["candidates_topk_tight", "postings_capped", "match_output"])
def test_order_of_rows_does_not_matter(name, spark, monkeypatch):
    from kindred.sources import views

    def rows():
        frame = Q.QUERIES[name](spark, SMALL)
        return plain([r.asDict() for r in frame.collect()], sorted(frame.columns))

    before, own = rows(), views.entities
    monkeypatch.setattr(views, "entities", lambda s, d: own(s, d).repartition(7, F.xxhash64("ord")).sortWithinPartitions(F.desc("ord")))
    assert rows() == before


def test_looser_cap_loses_no_hits(spark):
    from kindred.operators import blocking

    d = Q.Directory(spark, SMALL)
    few = {(r.s1_id, r.target_id) for r in blocking.hits(d.s1, blocking.postings(d.targets, Q.TIGHT)).collect()}
    many = {(r.s1_id, r.target_id) for r in blocking.hits(d.s1, blocking.postings(d.targets)).collect()}
    assert few <= many


def test_lower_threshold_predicts_no_less(spark):
    rows = sorted(Q.threshold_sweep(spark, SMALL).collect(), key=lambda r: r.threshold)
    assert [r.threshold for r in rows] == [k / 100 for k in range(10, 95, 2)]
    assert all(a.total_predicted_matches >= b.total_predicted_matches for a, b in zip(rows, rows[1:], strict=False))
