import random

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from kindred.llm import pieces as P
from tests.conftest import SMALL

ODD = ["", "a", " a", "a ", "  two   spaces    here ", "tab\tand\nbreaks\r\n\r\rend", "é é ﬁ Ａ 你好 🙂 \U0010ffff", "▁x▁▁y", "x" * 200, "ab" * 500, "-" * 120, "antidisestablishmentarianism" * 3, "<s> </s> <0x41> <unk>", "\x00\x1c\x7f", "    " * 20, "aaaaaaaaaaaa bbbbbb", "1234567890 3.14159", "foo();\r\nbar</p>\">"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=P.MODEL)


def test_documents(spark, library):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    rows = P.encoded_and_checked(docs.select("doc_id", "text")).collect()
    assert len(rows) == len(text)
    for r in rows:
        assert list(r.ids) == library.encode(text[r.doc_id]) and r.n_tokens == len(r.ids) and r.round_trip


def test_odd_texts(spark, library):
    r = random.Random(1)
    mixed = ["".join(r.choice(" ab éñ\n\t.,▁你🙂ing<>") for _ in range(r.randint(1, 60))) for _ in range(150)]
    docs = spark.createDataFrame([*((i, t, "x") for i, t in enumerate(ODD + mixed)), (None, None, "x"), (0, ODD[0], "x")], "doc_id long, text string, ids string")
    got = P.decode(P.encode(docs)).collect()
    assert len(got) == len(ODD) + len(mixed) + 2
    for row in got:
        text = row.text or ""
        assert list(row.ids) == library.encode(text), repr(text)
        assert row.decoded == text.replace("▁", " ")
    assert P.encode(docs.limit(0)).collect() == []


def test_lattice_equals_merging(spark):
    """The fold over edges against merging by a queue, on many distinct words."""
    own = P.Pieces.read(P.MODEL)
    r, words = random.Random(7), set()
    names = [p for p in own.ids if len(p) > 1 and "▁" not in p]
    while len(words) < 4000:
        words.add(("▁" if r.random() < 0.6 else "") + "".join(r.choice(names) if r.random() < 0.6 else r.choice("abcdeéñ字🙂-'") for _ in range(r.randint(1, 6))))
    words = [w for w in words if P.in_lattice(w)]
    found = spark.createDataFrame([(w,) for w in words], "unit string")
    got = {x.unit: list(x.ids) for x in P.unit_ids(found, own).collect()}
    assert len(got) == len(words)
    assert [w for w in words if got[w] != own.merge(w)] == []


def test_null_ids(spark):
    rows = P.decode(spark.range(2).select(F.when(F.col("id") == 0, F.array(F.lit(264))).alias("ids"))).collect()
    assert sorted(map(str, (r.decoded for r in rows))) == ["None", "a"]


def test_names(spark):
    docs = spark.createDataFrame([(1, "some text", 2, 3, 4)], "doc_id long, `my.text` string, own_mark int, `a.b` int, IDS int")
    rows = P.encoded_and_checked(docs, text_col="my.text")
    assert rows.columns == ["doc_id", "own_mark", "a.b", "ids", "n_tokens", "round_trip"]
    assert [(r["a.b"], r.own_mark, r.n_tokens, r.round_trip) for r in rows.collect()] == [(3, 2, 2, True)]
    again = P.decode(rows, text_col="my.text").collect()
    assert [r["my.text"] for r in again] == ["some text"]


def test_equal_hashes(spark, monkeypatch):
    """Units that the dictionary can't tell apart by their hashes get their own ids."""
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["alpha beta", "gamma delta", "beta"])], "doc_id long, text string")
    own = P.Pieces.read(P.MODEL)
    known = P.dictionary(docs.select("text"), own)()
    units = ["▁alpha", "▁beta"]
    lengths, ids = known.dictionary.look_up(units)
    keys, starts, all_ids = known.dictionary.open[next(iter(known.dictionary.open))]
    assert ids.tolist() == [i for u in units for i in own.merge(u)]
    for b in known.dictionary.open.values():
        b[2] = np.roll(np.array(b[2]), 1)  # as if another unit had come first
    lengths, ids = known.dictionary.look_up(units)
    assert ids.tolist() == [i for u in units for i in own.merge(u)] and lengths.tolist() == [len(own.merge(u)) for u in units]


def test_chunks_hold_the_units_of_the_text():
    own, r = P.Pieces.read(P.MODEL), random.Random(3)
    for t in ODD + ["".join(r.choice(" a.\n▁\t,é") for _ in range(r.randint(0, 30))) for _ in range(3000)]:
        whole = own.unit.findall(P.SPACE + t.replace(" ", P.SPACE)) if t else []
        assert [u for c in own.chunks(t) for u in own.units(c)] == whole, repr(t)


def test_many_chunks_are_cut_at_once():
    own, r = P.Pieces.read(P.MODEL), random.Random(4)
    for blanks in ([], ["", "▁▁", "▁▁▁▁"]):
        every = list({c for t in ODD for c in own.chunks(t)} | {"word", "word,", "\n", "\nnext", "\n\t", "\t", "x1.y"})
        for _ in range(200):
            some = [c for c in r.sample(every, 12) if c.strip(P.SPACE)] + blanks
            r.shuffle(some)
            units, at, sizes = own.cut(some)
            assert len(units) == len(set(units)) and [len(own.units(c)) for c in some] == sizes.tolist()
            assert [u for c in some for u in own.units(c)] == [units[i] for i in at], some
    assert [x if isinstance(x, list) else x.tolist() for x in own.cut([])] == [[], [], []]


class Merged:
    """In place of the dictionary: every unit by merging; says what was looked up."""

    def __init__(self, pieces):
        self.pieces, self.asked = pieces, []

    def look_up(self, wanted):
        self.asked += wanted
        every = [self.pieces.merge(u) for u in wanted]
        return np.array([len(x) for x in every], np.int64), np.array([i for x in every for i in x], np.int32)


def test_frequent_chunks_stay(library, monkeypatch):
    """A worker that has met too many chunks keeps those that come again, and learns the others anew."""
    monkeypatch.setattr(P, "MOST_KNOWN", 50)
    own = P.Pieces.read(P.MODEL)
    made = Merged(own)
    known = P.Known(own, made)
    for k in range(30):
        texts = [f"the the of of  end\n{chr(97 + k % 26)}{k}x word{k} word{k}{j}" for j in range(20)] + ODD[k % 5 :: 5] + [None]
        sizes, ids = known.encode(texts)
        assert [i.tolist() for i in np.split(ids, np.cumsum(sizes)[:-1])] == [library.encode(t or "") for t in texts]
    assert made.asked.count("▁the") == made.asked.count("▁of") == 1
    assert len(known) < 200
