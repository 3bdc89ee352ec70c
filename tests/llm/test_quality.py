import time

import pytest
from hypothesis import given
from hypothesis import strategies as st

from kindred.llm import quality
from kindred.llm.quality import Rules, assess, bad_line, clean_lines, repeated_words
from tests.conftest import SMALL
from tests.llm.brute import word_list


def base(text):
    text = text or ""
    words = word_list(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = {}
    for w in windows:
        times[w] = times.get(w, 0) + 1
    inside = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if word_list(x)]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": sum(x in lines[:i] for i, x in enumerate(lines)),
        "n_repeat_words": len(inside),
        "base_failed": len(words) < 10 or 100 * len(inside) > 20 * len(words),
    }


TEXTS = [None, "", " \n\t", "a\x1cb c\xa0d", "a b a b a b a b a b a b", "x\nx\n y\nx", "#*$%&|<> ok", "One two three four five six seven eight nine ten. " * 3]


@pytest.mark.parametrize("text", TEXTS)
def test_base(text):
    got = assess(text)
    assert {k: got[k] for k in base(text)} == base(text)


@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=60))
def test_repeated_words(words):
    want = base(" ".join(w.decode() for w in words))["n_repeat_words"]
    assert repeated_words(words) == want
    before, quality.MANY_WORDS = quality.MANY_WORDS, 0
    try:
        assert repeated_words(words) == want
    finally:
        quality.MANY_WORDS = before


LINES = {
    "Home | About us | Contact | Help": "navigation",
    "Home > Shop > Shoes": "navigation",
    "he### said*** that%%% it&&& was.": "symbols",
    "THIS IS NOT WHAT WE WANT TO READ HERE!!": "shouting",
    "the " * 30 + ".": "monotone",
    "All rights reserved.": "boilerplate",
    "Please enable JavaScript.": "boilerplate",
    "Cookies: what we use them for.": "boilerplate",
    "If you accept, a cookie is set.": "boilerplate",
    "A cookie is a small cake.": None,
    "Tous droits réservés.": "boilerplate",
    "no end here": "punctuation",
    "A plain sentence with an end.": None,
    'He said: "Yes."': None,
    "A long line without any end that still goes on for a while. And then more words follow it": None,
    "这是一个句子。": None,
    "Either A|B or C|D is right, and the pipes stand within words here.": None,
}


@pytest.mark.parametrize(("line", "rule"), LINES.items())
def test_lines(line, rule):
    assert bad_line(line.strip(), Rules()) == rule


@pytest.mark.parametrize("unit", ["cookie.", "cookies use ", "x", '."]*', " >>>>", "| ", "a\n", "|", "use cookie "])
def test_time_is_linear(unit):
    took = []
    for n in (100_000, 800_000):
        began = time.process_time()
        assess(unit * (n // len(unit)))
        bad_line("a b " + (unit * (n // len(unit))).replace(" ", "_"), Rules())
        took.append(time.process_time() - began)
    assert took[1] < 24 * took[0] + 0.3


def test_names(spark):
    docs = spark.createDataFrame([(1, "a", 2, 3, 4)], "doc_id long, `my.text` string, __in0 int, `a.b` int, KEPT int")
    assert clean_lines(docs, "my.text").columns[:4] == ["doc_id", "my.text", "__in0", "a.b"] and len(clean_lines(docs, "my.text").collect()) == 1


def test_verdicts(spark):
    good = "This is the first line of a good text, with words.\nAnd this is the second one of it."
    texts = [good, good + "\nHome | Shop | Help | More", "Home | Shop | Help\n" * 9, None, "", "too short", "word. " * 20_000]
    docs = spark.createDataFrame([(i if i else None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_words string")
    got = clean_lines(docs)
    assert got.columns[:2] == ["doc_id", "text"] and "n_words" in got.columns
    rows = {r.doc_id: r for r in got.collect()}
    assert [rows[i or None].kept for i in range(len(texts))] == [True, True, False, False, False, False, False]
    assert rows[1].clean_text == good and rows[1].n_lost_words == 7 and rows[None].clean_text == good
    assert clean_lines(docs.limit(0)).collect() == []


def test_large_ids_beside_nulls_stay_exact(spark):
    big = (1 << 62) + 1
    assert {r.doc_id for r in clean_lines(spark.createDataFrame([(big, "a"), (None, "b")], "doc_id long, text string")).collect()} == {big, None}


def test_query(spark):
    from kindred.llm.queries import op2_line_rules

    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = op2_line_rules(spark, SMALL).collect()
    assert len(rows) == len(text)
    for r in rows:
        want = base(text[r.doc_id])
        assert {k: r[k] for k in want} == want
        bad = [x for x in text[r.doc_id].split("\n") if word_list(x) and plain_rule(x)]
        assert (r.n_bad_lines, r.n_lost_words) == (len(bad), sum(len(word_list(x)) for x in bad))
        assert r.kept == (not want["base_failed"] and 2 * r.n_lost_words <= want["n_words"])


def plain_rule(line):
    """Whether a line breaks a rule, written out without the module's expressions."""
    words, low = line.split(), f" {line.lower()} "
    solid = "".join(words)
    n, marks = len(words), [w for w in words if set(w) <= set("|»›•·>/")]
    if len(marks) >= 2 and len(marks) >= 0.15 * n:
        return True
    if sum(c in "#*$%&|<>" for c in solid) > 0.1 * len(solid):
        return True
    cased = [c for c in solid if c.lower() != c.upper() and (c.isupper() or c.islower())]
    if n >= 5 and len(cased) >= 10 and sum(c.isupper() for c in cased) > 0.8 * len(cased):
        return True
    if n >= 20 and 4 * len(set(words)) <= n:
        return True
    if n <= 30 and any(p in low for p in ("lorem ipsum", "all rights reserved", "click here", "read more", "privacy policy", "cookie", "subscribe now", "powered by", "log in ", "sign in ", "sign up ")):
        return True
    ends = tuple(".!?…。！？؟।")
    closed = line.strip().rstrip("\"'”’»)]*_")
    if closed.endswith((*ends, ":", ";")):
        return False
    return n < 8 or not any(w.endswith(ends) for w in words)


def test_labels_agree(spark):
    from kindred.llm.queries import op2_line_rules

    sf = "/root/testdata/sf0.01"
    rows = op2_line_rules(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("n_words >= 10 and not base_failed").collect()
    assert sum(r.kept == bool(r.quality) for r in rows) > 0.97 * len(rows)
