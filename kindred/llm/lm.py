"""An interpolated modified Kneser-Ney model of word pairs, counted in Spark and read by workers through memory maps."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.shared import Hasher, Store, arrow_of, checkpointed, column, with_columns, words

#: The end of a text, as a word that no text has.
END = b"\x00end of text "
#: Tokens in a bucket of pairs, about; word numbers in a range of what comes after and before words.
BUCKET_TOKENS, RANGE_WORDS = 3_000_000, 250_000
#: Bytes of text for one bucket of words, and the least and most bits of a hash that name it.
WORD_BYTES, LEAST_BITS, MOST_BITS = 4 << 20, 6, 12
#: Texts whose words are objects at once.
SOME = 1000
#: Words that a bucket names as candidates for hot contexts.
TOP = 64
ADDED = 0.1


def packed(*arrays: np.ndarray) -> bytes:
    """Columns of whole numbers as bytes: byte planes, which compress well where high bytes are alike."""
    raw = b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(len(arrays[0]).to_bytes(8, "little") + raw)


def unpacked(blob: bytes, *kinds) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, at, out = int.from_bytes(raw[:8], "little"), 8, []
    for kind in map(np.dtype, kinds):
        planes = np.frombuffer(raw, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(n))
        at += n * kind.itemsize
    return out


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, with sums of their values."""
    if not len(keys):
        return (keys, *values)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return (keys[starts], *(np.add.reduceat(v[order], starts) for v in values))


def held_out(ident: int | None) -> bool:
    return zlib.crc32(b"" if ident is None else str(ident).encode()) % 10 == 0


def sequences(texts: list[str | None], hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, each followed by the end; and the number of each text's tokens."""
    parts, sizes = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for at in range(0, len(texts), SOME):
        found = [[*words(t), END] for t in texts[at : at + SOME]]
        sizes.append(np.fromiter(map(len, found), np.int64, len(found)))
        parts.append(hasher([w for f in found for w in f]))
    return np.concatenate(parts), np.concatenate(sizes)


def parted(where: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(part, places) of each part of 0 .. n - 1 that occurs, from one sort, however many parts there are."""
    order = np.argsort(where, kind="stable")
    names, starts = np.unique(where[order], return_index=True)
    for b, pick in zip(names.tolist(), np.split(order, starts[1:]), strict=len(names) > 0):
        if 0 <= b < n:
            yield b, pick


def by_hash(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Where the parts of sorted hashes by their first bits begin, but for the first."""
    return np.searchsorted(hashes, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits))


class Counts:
    """The model's files: sorted hashes and counts of words, by the first bits of the hash; sorted pairs of word numbers and
    their counts, by ranges of the first word (pairs with a hot first word over all buckets, by the second); and for each
    word number how many words come once, twice, more often after it, and how many come before it, by ranges of the number.
    A pair is two numbers of 32 bits; counts have 64 bits where a bucket needs them."""

    def __init__(self, store: Store, facts: dict | None = None):
        self.store, self.facts, self.open = store, facts or {}, {}

    def file(self, name: str, kind) -> np.ndarray:
        if name not in self.open:
            self.open[name] = self.store.load(name, kind)
        return self.open[name]

    # words

    def numbers(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers (-1: not in training) and counts of sorted distinct hashes."""
        number, count = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        cuts = by_hash(hashes, self.facts["bits"])
        for b, (lo, hi) in enumerate(zip([0, *cuts], [*cuts, len(hashes)], strict=True)):
            if lo < hi and len(known := self.file(f"words/{b}", np.uint64)):
                at = np.minimum(np.searchsorted(known, hashes[lo:hi]), len(known) - 1)
                hit = known[at] == hashes[lo:hi]
                number[lo:hi] = np.where(hit, at + self.facts["first"][b], -1)
                count[lo:hi] = np.where(hit, self.file(f"counts/{b}", np.int64)[at], 0)
        return number, count

    def tokens(self, texts: list[str | None], hasher: Hasher):
        """Numbers and counts of all tokens, contexts (start: the number after the last word's), sizes of the texts."""
        hashes, sizes = sequences(texts, hasher)
        distinct, at = np.unique(hashes, return_inverse=True)
        number, count = self.numbers(distinct)
        number, count = number[at], count[at]
        before = np.empty_like(number)
        before[1:] = number[:-1]
        before[np.cumsum(sizes) - sizes] = self.facts["V"]
        return number, count, before, sizes

    # pairs

    def bucket(self, pairs: np.ndarray) -> np.ndarray:
        first, n = (pairs >> np.uint64(32)).astype(np.int64), self.facts["buckets"]
        own = first * n // (self.facts["V"] + 1)
        second = (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
        return np.where(np.isin(first, self.facts["hot"]), second * 2654435761 % n, own)

    def pair_counts(self, pairs: np.ndarray) -> np.ndarray:
        """Of sorted distinct pairs."""
        out = np.zeros(len(pairs), np.int64)
        for b, pick in parted(self.bucket(pairs), self.facts["buckets"]):
            if len(known := self.file(f"pairs/{b}", np.uint64)):
                at = np.minimum(np.searchsorted(known, pairs[pick]), len(known) - 1)
                times = self.file(f"times/{b}", np.uint32)
                times = times if len(times) else self.file(f"long/{b}", np.int64)
                out[pick] = np.where(known[at] == pairs[pick], times[at], 0)
        return out

    def after(self, numbers: np.ndarray) -> np.ndarray:
        """(4, n): words that come once, twice, more often after each word, and words before it."""
        out = np.zeros((4, len(numbers)), np.int64)
        for r, pick in parted(np.where(numbers < 0, -1, numbers // self.facts["range"]), self.ranges()):
            if (table := self.file(f"after/{r}", np.uint32)).size:
                out[:, pick] = table.reshape(4, -1)[:, numbers[pick] - r * self.facts["range"]]
        return out

    def ranges(self) -> int:
        """Ranges of word numbers; the start of a text has the last number."""
        return self.facts["V"] // self.facts["range"] + 1

    # probabilities

    def log10(self, number: np.ndarray, before: np.ndarray, count_before: np.ndarray) -> np.ndarray:
        f = self.facts
        distinct, at = np.unique(number, return_inverse=True)
        cont = self.after(distinct)[3]
        d = np.array([0.0, *f["lower"]])
        low = np.maximum(cont - d[np.minimum(cont, 3)], 0) / max(1, f["types"]) + f["spare"] / (f["V"] + 1)
        low = low[at]
        known = (number >= 0) & (before >= 0)
        pairs = (before.clip(0).astype(np.uint64) << np.uint64(32)) | number.clip(0).astype(np.uint64)
        distinct, back = np.unique(pairs, return_inverse=True)
        times = np.where(known, self.pair_counts(distinct)[back], 0)
        distinct, back = np.unique(before, return_inverse=True)
        once, twice, more, _ = self.after(distinct)[:, back]
        d = np.array([0.0, *f["upper"]])
        total = np.maximum(count_before, 1)
        high = np.maximum(times - d[np.minimum(times, 3)], 0) / total
        gamma = (d[1] * once + d[2] * twice + d[3] * more) / total
        return np.log10(np.where((before >= 0) & (count_before > 0), high + gamma * low, low))


def discounts(n: list[int]) -> list[float]:
    """Of things that occur once, twice, more often; n: how many occur once to four times. 0.5 where a number is missing."""
    n1, n2, n3, n4 = n
    if not (n1 and n2):
        return [0.5, 0.5, 0.5]
    y = n1 / (n1 + 2 * n2)
    return [min(max(k - (k + 1) * y * b / a, 0.05), k - 0.05) if a else 0.5 * k for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]


def _frequencies(counts: np.ndarray) -> list[int]:
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)]


def train(docs: DataFrame, store: Store) -> dict:
    """Counts words and pairs of (text) rows into the store; returns the model's facts, whose size is bounded."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(MOST_BITS, max(LEAST_BITS, (size // WORD_BYTES).bit_length()))

    def word_parts(batches) -> Iterator[pd.DataFrame]:
        hasher = Hasher()
        for batch in batches:
            texts = batch.column(0).to_pylist()
            hashes, n = np.unique(sequences(texts, hasher)[0], return_counts=True)
            cuts = by_hash(hashes, bits)
            parts = [(b, packed(h, c)) for b, (h, c) in enumerate(zip(np.split(hashes, cuts), np.split(n.astype(np.uint32), cuts), strict=True)) if len(h)]
            yield pd.DataFrame({"part": [0] if texts else [], "docs": [len(texts)] if texts else [], "data": [b""] if texts else []})
            yield pd.DataFrame({"part": [b for b, _ in parts], "docs": [0] * len(parts), "data": [d for _, d in parts]})

    def word_merge(pdf: pd.DataFrame) -> pd.DataFrame:
        b, blobs = int(pdf["part"].iloc[0]), [x for x in pdf["data"] if x]
        keys, n = map(np.concatenate, zip(*(unpacked(x, np.uint64, np.uint32) for x in blobs), strict=True)) if blobs else (np.empty(0, np.uint64), np.empty(0, np.uint32))
        keys, n = summed(keys, n.astype(np.int64))
        store.save(f"words/{b}", keys)
        store.save(f"counts/{b}", n)
        top = np.argsort(-n, kind="stable")[:TOP]
        return pd.DataFrame({"part": [b], "facts": [json.dumps({"n": len(keys), "sum": int(n.sum()), "docs": int(pdf["docs"].sum()), "top": [[int(i), int(n[i])] for i in top]})]})

    parts = docs.select("text").mapInArrow(arrow_of(word_parts, "part int, docs long, data binary"), "part int, docs long, data binary")
    found = {r.part: json.loads(r.facts) for r in parts.groupBy("part").applyInPandas(word_merge, "part int, facts string").collect()}
    first, v = [], 0
    for b in range(1 << bits):
        first.append(v)
        v += found.get(b, {"n": 0})["n"]
    if v >= 2**32 - 1:
        raise ValueError(f"{v} distinct words; a pair holds two numbers of 32 bits")
    total, n_docs = sum(x["sum"] for x in found.values()), sum(x["docs"] for x in found.values())
    buckets = max(8, -(-total // BUCKET_TOKENS))
    hot = [first[b] + i for b, x in found.items() for i, n in x["top"] if n * 4 * buckets > total] + [v] * (n_docs * 4 * buckets > total)
    facts = {"V": v, "N": total, "docs": n_docs, "bits": bits, "range": RANGE_WORDS, "first": first, "buckets": buckets, "hot": sorted(hot)}
    model = Counts(store, facts)

    def pair_parts(batches) -> Iterator[pd.DataFrame]:
        hasher, own = Hasher(), Counts(model.store, model.facts)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            if not texts:
                continue
            number, _, before, _ = own.tokens(texts, hasher)
            pairs, n = np.unique((before.astype(np.uint64) << np.uint64(32)) | number.astype(np.uint64), return_counts=True)
            rows = []
            for b, pick in parted(own.bucket(pairs), facts["buckets"]):
                hi = (pairs[pick] >> np.uint64(32)).astype(np.uint32)
                rows.append((b, packed(np.diff(hi, prepend=np.uint32(0)), (pairs[pick] & np.uint64(0xFFFFFFFF)).astype(np.uint32), n[pick].astype(np.uint32))))
            yield pd.DataFrame(rows, columns=["part", "data"])

    def pair_merge(pdf: pd.DataFrame) -> pd.DataFrame:
        b, keys, counts = int(pdf["part"].iloc[0]), [], []
        for blob in pdf["data"]:
            hi, lo, n = unpacked(blob, np.uint32, np.uint32, np.uint32)
            keys.append((np.cumsum(hi, dtype=np.uint64) << np.uint64(32)) | lo)
            counts.append(n)
        pairs, n = summed(np.concatenate(keys), np.concatenate(counts).astype(np.int64))
        store.save(f"pairs/{b}", pairs)
        store.save(*((f"times/{b}", n.astype(np.uint32)) if n.max() < 2**32 else (f"long/{b}", n)))
        left, right = (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
        rows = [(-1, 0, json.dumps({"upper": _frequencies(n), "types": len(pairs)}).encode())]
        for kind, (ids, *values) in enumerate((summed(left, (n == 1) * 1, (n == 2) * 1, (n > 2) * 1), summed(right, np.ones(len(right), np.int64)))):
            for r, pick in parted(ids // facts["range"], model.ranges()):
                rows.append((r, kind, packed(ids[pick].astype(np.uint32), *(x[pick].astype(np.uint32) for x in values))))
        return pd.DataFrame(rows, columns=["part", "kind", "data"])

    def after_merge(pdf: pd.DataFrame) -> pd.DataFrame:
        r = int(pdf["part"].iloc[0])
        if r < 0:
            got = [json.loads(x) for x in pdf["data"]]
            return pd.DataFrame({"facts": [json.dumps({"upper": np.sum([x["upper"] for x in got], axis=0).tolist(), "types": sum(x["types"] for x in got)})]})
        low = r * facts["range"]
        table = np.zeros((4, min(facts["range"], facts["V"] + 1 - low)), np.int64)
        for kind, blob in zip(pdf["kind"], pdf["data"], strict=True):
            ids, *values = unpacked(blob, *[np.uint32] * (2 if kind else 4))
            for k, x in enumerate(values, 3 if kind else 0):
                table[k, ids.astype(np.int64) - low] += x
        store.save(f"after/{r}", table.astype(np.uint32))
        cont = table[3]
        return pd.DataFrame({"facts": [json.dumps({"lower": _frequencies(cont), "above": int((cont > 2).sum())})]})

    pairs = docs.select("text").mapInArrow(arrow_of(pair_parts, "part int, data binary"), "part int, data binary")
    tables = pairs.groupBy("part").applyInPandas(pair_merge, "part int, kind int, data binary").groupBy("part").applyInPandas(after_merge, "facts string")
    got = [json.loads(r.facts) for r in tables.collect()]
    upper = next((x["upper"] for x in got if "upper" in x), [0] * 4)
    lower = np.sum([[0] * 4, *(x["lower"] for x in got if "lower" in x)], axis=0).tolist()
    above = sum(x.get("above", 0) for x in got)
    facts |= {"types": sum(x.get("types", 0) for x in got), "upper": discounts(upper), "lower": discounts(lower)}
    d = facts["lower"]
    facts["spare"] = (d[0] * lower[0] + d[1] * lower[1] + d[2] * above) / facts["types"] if facts["types"] else 1.0
    return facts


SCORES = "held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def perplexity(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores every document with a model of the documents whose crc32 of the id (as text) isn't 0 modulo 10.

    Words and pairs (with a start and an end of each text) are counted in three passes: each task sums what it has seen and
    sends sorted, packed arrays by bucket; a bucket is merged by one task and written once. Buckets get about as many tokens
    at any size, and pairs with a hot first word go to all of them. ValueError for 2^32 distinct words or more. P(w | u) = (c(uw) - D) / c(u) + gamma(u) * (words before
    w - D') / (pairs) with modified Kneser-Ney discounts, interpolated with 1 / (V + 1) for any word. Words that no training
    text has get that last share; after such a word, and after none, the lower order counts alone.

    Returns the id with held_out, n_tokens, n_known (tokens that training has), train_tokens, base_score (add-0.1 unigrams),
    score (log10 probability by the model, the end included) and perplexity. Null text is empty: one token, the end. Null ids
    count as empty ids, which are held out. Copies count as often as they occur. An empty table gives an empty result. The
    model's files lie in the shared folder until all rows are scored.
    """
    rows = docs.select(column(id_col).alias("id"), column(text_col).alias("text"))
    training = rows.filter(F.crc32(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")) % 10 != 0)
    store = Store.new(docs.sparkSession, "pairs")
    facts = train(training, store)

    def score(ids, texts):
        model, hasher = Counts(store, facts), Hasher()
        for at in range(0, len(texts), 2000):
            part = texts[at : at + 2000]
            number, count, before, sizes = model.tokens(part, hasher)
            starts = np.cumsum(sizes) - sizes
            earlier = np.empty_like(count)
            earlier[1:] = count[:-1]
            earlier[starts] = facts["docs"]
            base = np.log10((count + ADDED) / (facts["N"] + ADDED * (facts["V"] + 1)))
            got = np.add.reduceat(model.log10(number, before, earlier), starts)
            base, known = np.add.reduceat(base, starts), np.add.reduceat((count > 0).astype(np.int64), starts)
            for k, i in enumerate(ids[at : at + 2000]):
                yield held_out(i), int(sizes[k]), int(known[k]), facts["N"], float(base[k]), float(got[k])

    scored = with_columns(rows, ["id", "text"], SCORES, score, ("text",))
    scored = checkpointed(scored.withColumnRenamed("id", id_col).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))))
    store.delete()
    return scored
