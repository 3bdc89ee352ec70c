import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from kindred.llm import lm
from tests.conftest import SMALL
from tests.llm.brute import lowered, word_list

END, START = "<end>", "<start>"


class Plain:
    def __init__(self, docs):
        self.c, self.b = Counter(), Counter()
        for i, t in docs:
            if not lm.held_out(i):
                s = self.tokens(t)
                self.c.update(s)
                self.b.update(zip([START, *s], s, strict=False))
        self.N, self.V, self.T = sum(self.c.values()), len(self.c), len(self.b)
        self.total, self.after, self.cont = Counter(), defaultdict(lambda: [0, 0, 0]), Counter()
        for (u, v), k in self.b.items():
            self.total[u] += k
            self.after[u][min(k, 3) - 1] += 1
            self.cont[v] += 1
        of = lambda c: lm.discounts([sum(x == k for x in c.values()) for k in (1, 2, 3, 4)])
        self.upper, self.lower = of(self.b), of(self.cont)
        self.spare = sum(self.lower[min(x, 3) - 1] for x in self.cont.values()) / self.T if self.T else 1.0

    def tokens(self, t):
        return [*word_list(lowered(t)), END]

    def p(self, u, v):
        low = (self.cont[v] - self.lower[min(self.cont[v], 3) - 1] if self.cont[v] else 0) / max(1, self.T) + self.spare / (self.V + 1)
        if not self.total[u]:
            return low
        k = self.b[u, v]
        high = (k - self.upper[min(k, 3) - 1] if k else 0) / self.total[u]
        return high + sum(d * n for d, n in zip(self.upper, self.after[u], strict=True)) / self.total[u] * low


def check(spark, rows, docs):
    plain = Plain(docs)
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in rows)
    want = []
    for i, t in docs:
        s = plain.tokens(t)
        base = sum(math.log10((plain.c[w] + 0.1) / (plain.N + 0.1 * (plain.V + 1))) for w in s)
        score = sum(math.log10(plain.p(u, v)) for u, v in zip([START, *s], s, strict=False))
        want.append((str(i), lm.held_out(i), len(s), sum(w in plain.c for w in s), plain.N, round(base, 6), round(score, 6)))
    assert [g[:5] for g in got] == [w[:5] for w in sorted(want)]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in sorted(want)], atol=2e-5)
    return plain


def test_parts():
    where = np.array([3, -1, 0, 3, 9, 0])
    assert {b: p.tolist() for b, p in lm.parted(where, 9)} == {3: [0, 3], 0: [2, 5]} and list(lm.parted(where[:0], 9)) == []


def test_time_of_a_batch_is_flat():
    """However many buckets there are."""
    import time

    pairs, took = np.random.default_rng(0).integers(0, 1 << 40, 1_000_000), []
    for n in (28, 1700):
        began = time.process_time()
        assert sum(len(p) for _, p in lm.parted(pairs % n, n)) == len(pairs)
        took.append(time.process_time() - began)
    assert took[1] < 3 * took[0] + 0.1


@pytest.mark.parametrize("small", [False, True])
def test_query(spark, small, monkeypatch):
    """Small buckets make words hot, so that pairs are dealt over all buckets; ranges and buckets of words are small too."""
    from kindred.llm.queries import op5_kneser_ney

    if small:
        monkeypatch.setattr(lm, "BUCKET_TOKENS", 2000)
        monkeypatch.setattr(lm, "RANGE_WORDS", 700)
        monkeypatch.setattr(lm, "WORD_BYTES", 5000)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    rows = op5_kneser_ney(spark, SMALL).collect()
    plain = check(spark, rows, docs)
    for u in ("the", "of", START, "unheard"):
        assert sum(plain.p(u, v) for v in [*plain.c, "unheard"]) == pytest.approx(1)
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_odd_rows(spark):
    docs = [(None, "a b"), (1, None), (2, ""), (3, "a a a \x1c É é"), (4, "a b"), (4, "a b"), (6, "w " * 20_000), (10, "new words")]
    rows = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, score string")
    check(spark, lm.perplexity(rows).collect(), docs)
    assert lm.perplexity(rows.limit(0)).collect() == []
    only_held = [(i, "a b") for i in range(60) if lm.held_out(i)]
    check(spark, lm.perplexity(spark.createDataFrame(only_held, "doc_id long, text string")).collect(), only_held)


def test_packing():
    a, b = np.array([3, 1, 2**40], np.uint64), np.array([1, 2, 3], np.uint32)
    for x, y in zip((a, b), lm.unpacked(lm.packed(a, b), np.uint64, np.uint32), strict=True):
        assert (x == y).all()
