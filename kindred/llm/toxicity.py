"""Toxicity grades by a cumulative-link model.

Grades come from two judgements of the labels, not from the texts: 0 for a document that isn't toxic, 1 for a toxic one of low
quality, 2 for a toxic one that is otherwise good, so that no other rule would remove it."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.shared import column, sampled_texts, with_columns

#: Labelled documents that the model is fitted on at most, the first by a hash of the id; bytes of text that they have at most.
SAMPLE, SAMPLE_BYTES = 10_000, 64 << 20
GRADES = 3
#: Documents of the sample that a feature must occur in; standard deviations that its share must differ by; features at most.
LEAST_DOCS, LEAST_Z, MOST_FEATURES = 5, 4.0, 5_000
EDGES = " \t\n\x0b\x0c\r.,;:!?\"'()[]{}*_-#$%&|<>/\\…“”‘’«»¿¡"


def features(text: str | None) -> Counter:
    """Words of a text in lower case, without punctuation at their edges, with how often they occur."""
    return Counter(filter(None, (w.strip(EDGES) for w in (text or "").lower().split())))


@dataclass
class CumulativeLink:
    """P(grade >= k) = 1 / (1 + exp(cut[k] - weights . x)) for rising cuts: one list of weights for all thresholds."""

    words: dict[str, int]
    weights: np.ndarray
    cuts: np.ndarray

    def at_least(self, counts: Counter) -> np.ndarray:
        own, x = self.words, 0.0
        for w in sorted(counts.keys() & own.keys()):
            x += self.weights[own[w]] * (1 + np.log(counts[w]))
        return 1 / (1 + np.exp(np.clip(self.cuts - x, -60, 60)))


def chosen(found: list[Counter], toxic: np.ndarray) -> list[str]:
    """Words whose share of toxic documents differs clearly from that of the others, the clearest first."""
    p, every, bad = float(toxic.mean()) if len(toxic) else 0.0, Counter(), Counter()
    for words, is_toxic in zip(found, toxic, strict=True):
        every.update(words.keys())
        if is_toxic:
            bad.update(words.keys())
    z = {w: (bad[w] - k * p) / max(k * p * (1 - p), 1e-9) ** 0.5 for w, k in every.items() if k >= LEAST_DOCS}
    return sorted((w for w, x in z.items() if abs(x) >= LEAST_Z), key=lambda w: (-abs(z[w]), w))[:MOST_FEATURES]


def fit(texts: list[str | None], grade: list[int], steps: int = 400, rate: float = 0.1, ridge: float = 1e-3) -> CumulativeLink:
    """Maximum likelihood of the grades (0 to GRADES - 1) with a ridge, by Adam."""
    grade, found = np.asarray(grade, np.int64), [features(t) for t in texts]
    names = chosen(found, grade > 0)
    words = {w: i for i, w in enumerate(names)}
    row, col, value, docs = [], [], [], texts
    for i, d in enumerate(found):
        for w in sorted(d.keys() & words.keys()):
            row.append(i), col.append(words[w]), value.append(1 + np.log(d[w]))
    row, col, value = np.array(row, np.int64), np.array(col, np.int64), np.array(value, float)
    n, k = max(1, len(docs)), GRADES - 1
    weights, free = np.zeros(len(names)), np.array([2.0, *[np.log(0.5)] * (k - 1)])  # the first cut, logs of the gaps after it
    m, v = np.zeros(len(names) + k), np.zeros(len(names) + k)
    for step in range(1, steps + 1 if len(docs) else 1):
        cuts = free[0] + np.concatenate(([0], np.cumsum(np.exp(free[1:]))))
        x = np.bincount(row, value * weights[col], len(docs))
        tail = 1 / (1 + np.exp(np.clip(cuts[None, :] - x[:, None], -60, 60)))  # P(grade >= 1..k)
        full = np.hstack((np.ones((len(docs), 1)), tail, np.zeros((len(docs), 1))))
        p = np.maximum(full[np.arange(len(docs)), grade] - full[np.arange(len(docs)), grade + 1], 1e-12)
        slope = np.hstack((np.zeros((len(docs), 1)), tail * (1 - tail), np.zeros((len(docs), 1))))
        up, down = slope[np.arange(len(docs)), grade] / p, slope[np.arange(len(docs)), grade + 1] / p
        g_x = -(up - down) / n
        g_cut = np.array([((grade == j) * up).sum() - ((grade == j - 1) * down).sum() for j in range(1, k + 1)]) / n
        g_free = np.concatenate(([g_cut.sum()], [np.exp(free[j]) * g_cut[j:].sum() for j in range(1, k)]))
        g = np.concatenate((np.bincount(col, value * g_x[row], len(names)) + ridge * weights / n * 10, g_free))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        change = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        weights, free = weights - change[: len(names)], free - change[len(names) :]
    return CumulativeLink(words, weights, free[0] + np.concatenate(([0], np.cumsum(np.exp(free[1:])))))


def grades(
    docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", quality_col: str = "quality", sample_bytes: int = SAMPLE_BYTES
) -> DataFrame:
    """Adds severity (expected grade, 0 to 2), grade (the likeliest) and toxic (P(grade >= 1) is over one half) to every row.

    A labelled document's grade is 0 if it isn't toxic, 1 if it is toxic and of low quality, 2 if it is toxic and otherwise
    good (labels without a quality: 2), the greatest of its labels. The model is fitted on the driver on a sample of labelled
    documents of bounded size (10,000, the first by a hash of the id, with 64 MB of text in all), and has 5,000 words at most.
    Each whole text is then scored where it lies. Null text counts as empty; labels with null in id or label aren't used;
    without any label the severity is that of the model's start. Input columns of the results' names are replaced. Empty tables
    are fine.
    """
    good = F.coalesce(column(quality_col).cast("int"), F.lit(1)) if quality_col in labels.columns else F.lit(1)
    grade = F.when(column(label_col).cast("int") > 0, F.lit(1) + F.when(good > 0, 1).otherwise(0)).otherwise(0)
    own = labels.filter(column(id_col).isNotNull() & column(label_col).isNotNull()).groupBy(column(id_col).alias("id")).agg(F.max(grade).alias("grade"))
    picked = own.join(docs.select(column(id_col).alias("id")).distinct(), "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(sample)
    graded = {r.id: r.grade for r in picked.collect()}
    found = sampled_texts(docs.select(column(id_col).alias("id"), column(text_col).alias("text")), picked, sample_bytes)
    ids = sorted(found, key=str)
    model = fit([found[i] for i in ids], [graded[i] for i in ids])

    def score(texts):
        for t in texts:
            tail = model.at_least(features(t))
            full = np.concatenate(([1.0], tail, [0.0]))
            yield float(tail.sum()), int(np.argmax(full[:-1] - full[1:])), bool(tail[0] > 0.5)

    return with_columns(docs, [text_col], "severity double, grade int, toxic boolean", score)
