"""Encoding with a SentencePiece model as a relational lattice, and decoding."""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.llm.shared import Store, column, in_arrow, releasing, spread

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Code points of a unit that the lattice handles; its borders are bits of a long. Others are merged by the workers.
LONGEST = 48
#: Distinct units in a file of the dictionary and in a task of the lattice, about.
BUCKET_UNITS, TASK_UNITS = 16_000, 20_000
#: Chunks that a worker keeps at once, and texts that it handles at once.
MOST_KNOWN, BLOCK = 200_000, 250
#: What a chunk begins with, and a text's chunks where it has runs of spaces or U+2581.
BORDERS = f"{SPACE}\n"
CHUNK = re.compile(f"\n[^{SPACE}\n]*|{SPACE}*[^{SPACE}\n]+|{SPACE}+")


@dataclass(frozen=True)
class Pieces:
    """What a model file holds: pieces, their order of merging (0 first) and the id of byte 0."""

    names: list[str]
    rank: list[int]
    first_byte: int
    ids: dict[str, int] = field(default_factory=dict)
    longest: int = 0
    unit: re.Pattern = re.compile("")

    @classmethod
    def read(cls, path: str) -> Pieces:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        byte = next(i for i in range(n) if sp.is_byte(i))
        ids = {p: i for i, p in enumerate(names) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
        if any(len(p) > 1 and (SPACE in p.lstrip(SPACE) or re.search("[\n\t]", p)) for p in ids):
            raise ValueError("a piece crosses the border of a unit")
        # marks that no piece has behind a letter: what comes before them is never merged with them
        joined = {p[i] for p in ids for i in range(1, len(p)) if p[i - 1].isalpha()}
        ends = "".join(re.escape(c) for c in map(chr, range(33, 127)) if not c.isalnum() and c not in joined)
        unit = re.compile(f"[\n\t]|{SPACE}*[^\\W\\d_]+(?=[{SPACE}\n\t{ends}]|\\Z)|{SPACE}*[^{SPACE}\n\t]+|{SPACE}+")
        order = {x: i for i, x in enumerate(sorted({-sp.get_score(i) for i in ids.values()}))}
        return cls(names, [order.get(-sp.get_score(i), 0) for i in range(n)], byte, ids, max(map(len, ids)), unit)

    @staticmethod
    def chunks(text: str | None) -> list[str]:
        """A text cut before each run of spaces and each line break. A chunk stands for the same units wherever it is: it is
        written without its space where it has one, as most have, so that most texts are cut by str.split."""
        if not text:
            return []
        if "\n" in text:
            text = text.replace("\n", " \n")
        if "  " in text or text[0] == " " or SPACE in text:
            found = CHUNK.findall(SPACE + text.replace(" \n", "\n").replace(" ", SPACE))
            return [c[1:] if c[0] == SPACE and c[1:2] != SPACE else c for c in found]
        return text.split(" ")

    def units(self, chunk: str) -> list[str]:
        """A chunk in parts that no piece crosses: words with the spaces before them, marks, line breaks."""
        return self.unit.findall(chunk if chunk[:1] in (SPACE, "\n") and chunk else SPACE + chunk)

    def found(self, chunks: list[str]) -> tuple[list[str], list[int]]:
        """Units of many chunks, one behind the other, cut in one go; without the chunks of spaces only, which would run into
        the next one. The places of these are given: each is one unit, the empty chunk a space."""
        blank: list[int] = []
        text = SPACE + SPACE.join(chunks) if chunks else ""
        if SPACE * 2 in text:
            blank = [i for i, c in enumerate(chunks) if not c.strip(SPACE)]
            text = "".join([c if c[0] in BORDERS else SPACE + c for c in chunks if c.strip(SPACE)])
        return self.unit.findall(text.replace(f"{SPACE}\n", "\n")), blank

    def cut(self, chunks: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Distinct units of many chunks, the numbers of each chunk's units in their order, and how many each chunk has."""
        found, blank = self.found(chunks)
        alone = [chunks[i] or SPACE for i in blank]
        distinct = list(dict.fromkeys(chain(found, alone)))
        number = dict(zip(distinct, range(len(distinct)), strict=True))
        at = np.fromiter(map(number.__getitem__, found), np.int64, len(found))
        # a unit begins a chunk if it begins with a space or a line break
        first = np.append(np.flatnonzero(np.fromiter([u[0] in BORDERS for u in distinct], bool, len(distinct))[at]), len(at))
        sizes = np.diff(first)
        if blank:
            before = np.array(blank) - np.arange(len(blank))  # other chunks before each
            at, sizes = np.insert(at, first[before], [number[u] for u in alone]), np.insert(sizes, before, 1)
        return distinct, at, sizes

    def bytes_of(self, char: str) -> list[int]:
        return [self.first_byte + b for b in char.encode("utf-8", "surrogatepass")]

    def merge(self, unit: str) -> list[int]:
        """Ids of one unit by merging pairs, least rank first, then from the left; for what the lattice leaves."""
        end = list(range(1, len(unit) + 1))  # of the symbol that starts at i; 0: none starts there
        before = list(range(-1, len(unit) - 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = end[i]
            if i >= 0 and j < len(unit) and (k := self.ids.get(unit[i : end[j]])) is not None:
                heapq.heappush(heap, (self.rank[k], i, j, end[j]))

        for i in range(len(unit)):
            offer(i)
        while heap:
            _, i, j, e = heapq.heappop(heap)
            if end[i] == j and end[j] == e:
                end[i], end[j] = e, 0
                if e < len(unit):
                    before[e] = i
                    offer(i)
                if before[i] >= 0:
                    offer(before[i])
        out, i = [], 0
        while i < len(unit):
            k = self.ids.get(unit[i : end[i]])
            out += self.bytes_of(unit[i]) if k is None else [k]
            i = end[i]
        return out


def in_lattice(unit: str) -> bool:
    """Runs of spaces are left out: their pieces share one rank, so the order of merging isn't that of the edges."""
    return len(unit) <= LONGEST and not unit.startswith(SPACE * 2)


#: The same in SQL.
IN_LATTICE = f"length(unit) <= {LONGEST} AND NOT startswith(unit, '{SPACE * 2}')"
#: An edge as a long: rank, start, end, and 1 + id (0 for a character without a piece), so that longs sort by rank and place.
START, END, ID = "cast(shiftright({x}, 23) & 63 AS int)", "cast(shiftright({x}, 17) & 63 AS int)", "cast({x} & 131071 AS int) - 1"


def unit_ids(found: DataFrame, pieces: Pieces) -> DataFrame:
    """(unit, ids) of distinct units.

    Substrings of bounded length are joined to the table of pieces (its size is fixed by the model), which gives the edges
    of each unit's lattice; they are grouped by unit, in order of rank and place, and folded: the state is a set of borders
    as bits, and an edge between two borders with exactly one border between them takes that border away. What is left
    between borders are the pieces; a character without a piece becomes its bytes."""
    rows = [(p, (pieces.rank[i] << 29) + i + 1) for p, i in pieces.ids.items()]
    table = found.sparkSession.createDataFrame(pd.DataFrame(rows, columns=["piece", "code"]), "piece string, code long")
    # substring k of a text, by its end and then its start: k = end * (end - 1) / 2 + start
    every = found.select("unit", F.explode(F.expr("sequence(0, length(unit) * (length(unit) + 1) div 2 - 1)")).alias("k"))
    every = every.withColumn("e", F.expr("cast((sqrt(8.0D * k + 1.0D) - 1.0D) / 2.0D AS int) + 1"))
    every = every.withColumn("s", F.expr("k - cast(e * (e - 1) / 2 AS int)")).filter(F.col("e") - F.col("s") <= pieces.longest)
    edges = every.select("unit", F.expr("(s << 23) + (e << 17)").alias("place"), F.expr("e - s").alias("n"), F.expr("substring(unit, s + 1, e - s)").alias("piece"))
    edges = edges.join(F.broadcast(table), "piece", "left").filter("code is not null or n = 1")
    lattice = edges.groupBy("unit").agg(F.sort_array(F.collect_list(F.coalesce("code", F.lit(0)) + F.col("place"))).alias("edges"))
    start, end, ident = (t.format(x="x") for t in (START, END, ID))
    inner = f"(st & (shiftleft(1L, {end}) - shiftleft(2L, {start})))"
    ends = f"(shiftright(st, {start}) & shiftright(st, {end}) & 1L) = 1L"
    borders = f"""aggregate(edges, shiftleft(2L, length(unit)) - 1L,
        (st, x) -> CASE WHEN {ends} AND {inner} <> 0L AND ({inner} & ({inner} - 1L)) = 0L THEN st - {inner} ELSE st END)"""
    path = f"sort_array(transform(filter(edges, x -> {ends} AND {inner} = 0L), x -> x & {(1 << 29) - 1}L))"  # by place
    char = "substring(unit, cast(shiftright(x, 23) AS int) + 1, 1)"
    code = f"""transform(sequence(1, octet_length({char})),
        i -> {pieces.first_byte} + cast(conv(substring(hex(encode({char}, 'utf-8')), 2 * i - 1, 2), 16, 10) AS int))"""
    return (
        lattice.withColumn("st", F.expr(borders))
        .withColumn("path", F.expr(path))
        .select("unit", F.expr(f"CASE WHEN exists(path, x -> (x & 131071L) = 0L) THEN flatten(transform(path, x -> CASE WHEN (x & 131071L) = 0L THEN {code} ELSE array({ident}) END)) ELSE transform(path, x -> {ident}) END").alias("ids"))
    )


class Dictionary:
    """Ids of units in files of the shared folder: sorted hashes, and where each unit's ids begin. The number of files grows
    with the number of units, so that a task that writes one holds a bounded number."""

    def __init__(self, store: Store, bits: int, pieces: Pieces):
        self.store, self.bits, self.pieces, self.open = store, bits, pieces, {}
        self.pool, self.sizes, self.first = pool(pieces, SPACE)

    @staticmethod
    def write(store: Store, found: DataFrame, bits: int) -> None:
        def run(rows: pa.Table) -> pa.Table:
            b, keys = rows["part"][0].as_py(), rows["hash"].to_numpy().view(np.uint64)
            order = np.argsort(keys)
            ids = rows["ids"].combine_chunks().take(pa.array(order))
            store.save(f"keys/{b}", keys[order])
            store.save(f"starts/{b}", np.concatenate(([0], np.cumsum(ids.value_lengths().to_numpy()))).astype(np.int64))
            store.save(f"ids/{b}", ids.flatten().to_numpy().astype(np.int32))
            return pa.table({"n": [len(keys)]})

        keyed = found.select(F.xxhash64("unit").alias("hash"), "ids")
        keyed.withColumn("part", F.shiftrightunsigned("hash", 64 - bits).cast("int")).groupBy("part").applyInArrow(run, "n long").agg(F.sum("n")).collect()

    def look_up(self, wanted: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids of each unit, and all the ids. What is found is compared with the unit; two units of one hash
        can't be told apart by it, so such a unit is merged here."""
        texts = list(map(str.encode, wanted))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, texts, repeat(42)), np.uint64, len(texts))
        order = np.argsort(hashes)
        cuts = np.searchsorted(hashes[order], np.arange(1, 1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits))
        lengths, parts = np.zeros(len(wanted), np.int64), []
        for b, pick in enumerate(np.split(order, cuts)):
            if len(pick):
                if b not in self.open:
                    self.open[b] = [self.store.load(f"{n}/{b}", k) for n, k in (("keys", np.uint64), ("starts", np.int64), ("ids", np.int32))]
                keys, starts, ids = self.open[b]
                at = np.searchsorted(keys, hashes[pick])
                if at[-1] == len(keys) or (keys[at] != hashes[pick]).any():
                    raise KeyError("a unit isn't in the dictionary")
                lengths[pick] = starts[at + 1] - starts[at]
                parts.append(ids[spread(starts[at], lengths[pick])])
        back = np.empty(len(order), np.int64)  # parts are in order of hashes; give them in the order asked
        back[order] = np.cumsum(lengths[order]) - lengths[order]
        ids = np.concatenate([np.empty(0, np.int32), *parts])[spread(back, lengths)]
        raw = self.pool[spread(self.first[ids], self.sizes[ids])].tobytes()
        if raw != b"".join(texts):
            ends = np.concatenate(([0], np.cumsum(self.sizes[ids])))[np.concatenate(([0], np.cumsum(lengths)))]
            every = np.split(ids, np.cumsum(lengths)[:-1])
            every = [own if raw[a:b] == t else np.array(self.pieces.merge(u), np.int32) for own, t, u, a, b in zip(every, texts, wanted, ends[:-1], ends[1:], strict=True)]
            lengths, ids = np.fromiter(map(len, every), np.int64, len(every)), np.concatenate(every)
        return lengths, ids


def pool(pieces: Pieces, space: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all pieces, one behind the other, with their sizes and places; what stands for a space is given."""
    held = [p.replace(SPACE, space).encode() for p in pieces.names]
    for b in range(256):
        held[pieces.first_byte + b] = bytes([b])
    sizes = np.fromiter(map(len, held), np.int64, len(held))
    return np.frombuffer(b"".join(held), np.uint8), sizes, np.cumsum(sizes) - sizes


class Known(dict):
    """Numbers of chunks that a worker has seen, and their ids in one array."""

    def __init__(self, pieces: Pieces, dictionary: Dictionary):
        super().__init__()
        self.pieces, self.dictionary = pieces, dictionary
        self.fresh: list[str] = []
        self.lengths, self.starts, self.ids = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)
        self.met = np.empty(0, np.int64)  # how often each came

    def forget(self) -> None:
        """Keeps the chunks that came twice since the last time, or none if they are too many."""
        kept = np.flatnonzero(self.met >= 2)
        kept = kept if len(kept) <= MOST_KNOWN // 2 else kept[:0]
        names, sizes = list(self), self.lengths[kept]
        self.clear()
        self.update(zip([names[i] for i in kept], range(len(kept)), strict=True))
        self.ids = self.ids[spread(self.starts[kept], sizes)]
        self.lengths, self.starts, self.met = sizes, np.cumsum(sizes) - sizes, np.zeros(len(kept), np.int64)

    def __missing__(self, chunk: str) -> int:
        self.fresh.append(chunk)
        self[chunk] = n = len(self)
        return n

    def learn(self) -> None:
        """Ids of the chunks that are new."""
        number, at, cut = self.pieces.cut(self.fresh)
        listed = list(filter(in_lattice, number))
        lengths, ids = self.dictionary.look_up(listed)
        if len(listed) < len(number):  # the others are merged here; all are put in the order of their numbers
            every = iter(np.split(ids, np.cumsum(lengths)[:-1]))
            cuts = [next(every) if in_lattice(u) else np.array(self.pieces.merge(u), np.int32) for u in number]
            lengths, ids = np.fromiter(map(len, cuts), np.int64, len(cuts)), np.concatenate(cuts)
        ends = np.concatenate(([0], np.cumsum(lengths[at])))
        sizes = np.diff(ends[np.concatenate(([0], np.cumsum(cut)))])
        self.starts = np.concatenate((self.starts, len(self.ids) + np.cumsum(sizes) - sizes))
        self.lengths = np.concatenate((self.lengths, sizes))
        self.ids, self.fresh = np.concatenate((self.ids, ids[spread((np.cumsum(lengths) - lengths)[at], lengths[at])])), []

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids of each text, and all the ids."""
        if len(self) > MOST_KNOWN:
            self.forget()
        cut = [self.pieces.chunks(t) for t in texts]
        at = np.fromiter(map(self.__getitem__, chain.from_iterable(cut)), np.int64)
        if self.fresh:
            self.learn()
        self.met = np.bincount(at, minlength=len(self)) + np.pad(self.met, (0, len(self) - len(self.met)))
        each = self.lengths[at]
        ends = np.concatenate(([0], np.cumsum(each)))
        bounds = np.concatenate(([0], np.cumsum(np.fromiter(map(len, cut), np.int64, len(cut)))))
        return np.diff(ends[bounds]), self.ids[spread(self.starts[at], each)]


def by_blocks(df: DataFrame, name: str, added: str, start: Callable, dropped: tuple[str, ...] = ()) -> DataFrame:
    """df without the dropped columns, with those of a DDL string, made from blocks of one column by start()(array), which
    gives Arrow arrays. Columns of df with the names of added ones (in any case of letters) are replaced."""
    def run(batches):
        make = start()
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                yield part.columns[1:], make(part.column(0))

    return in_arrow(df, [name], T._parse_datatype_string(added), run, dropped)


def dictionary(texts: DataFrame, pieces: Pieces) -> Callable[[], Known]:
    """Ids of all distinct units of (text) in the shared folder; returns what opens them in a worker."""
    spark = texts.sparkSession

    def seen(batches):
        known: set[str] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                fresh = list(set(chain.from_iterable(map(pieces.chunks, batch.column(0).slice(at, BLOCK).to_pylist()))).difference(known))
                if len(known) > MOST_KNOWN:
                    known.clear()
                known.update(fresh)
                found, blank = pieces.found(fresh)
                yield pa.RecordBatch.from_arrays([pa.array({*found, *(fresh[i] or SPACE for i in blank)}, pa.string())], ["unit"])

    store = Store.new(spark, "units")
    store.delete_at_exit()
    # copies go in each task before units are exchanged
    found = store.table(texts.mapInArrow(releasing(seen), "unit string").filter(IN_LATTICE).distinct(), "found")
    n = found.count()
    bits = max(6, (n // BUCKET_UNITS).bit_length())
    # An aggregate that sorts in memory, in a session of its own: the one by hash hands its rows to a sorter on disk after a
    # few units. A unit's edges take some ten times its room, so units are dealt to tasks by their number.
    own = spark.newSession()
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // TASK_UNITS)
    own.conf.set("spark.sql.shuffle.partitions", str(tasks))
    own.conf.set("spark.sql.execution.useObjectHashAggregateExec", "false")
    listed = own.read.schema("unit string").parquet(f"{store.uri}/found").repartition(tasks, "unit")
    Dictionary.write(store, unit_ids(listed, pieces), bits)
    return lambda: Known(pieces, Dictionary(store, bits, pieces))


def encode(docs: DataFrame, model: str = MODEL, text_col: str = "text") -> DataFrame:
    """Adds ids (array of int) and n_tokens, as the model's own library gives them, to every row.

    A text is cut into units that no piece crosses (a word with the spaces before it, the marks after it, a line break).
    Distinct units go through unit_ids; the few with several spaces or over 48 characters are merged in the workers by the
    same rule. The result is written as sorted hashes to the shared folder, where the workers map it and compare what they
    find with the unit, so that texts are never exchanged; its files are needed whenever the result is read, and go when the
    driver's Python ends. Null and empty text have no ids. Input columns of the results' names are replaced. An empty table
    gives an empty result.
    """
    opened = dictionary(docs.select(column(text_col).alias("text")), Pieces.read(model))

    def start():
        known = opened()

        def make(texts: pa.Array) -> list[pa.Array]:
            sizes, ids = known.encode(texts.to_pylist())
            return lists_of(sizes, ids)

        return make

    return by_blocks(docs, text_col, "ids array<int>, n_tokens long", start)


def lists_of(sizes: np.ndarray, ids: np.ndarray) -> list[pa.Array]:
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32())), pa.array(sizes, pa.int64())]


class Decoder:
    def __init__(self, pieces: Pieces):
        self.pool, self.sizes, self.first = pool(pieces, " ")

    def texts(self, lengths: np.ndarray, ids: np.ndarray) -> list[str]:
        """Texts of lists of ids, which lie one behind the other."""
        sizes = self.sizes[ids]
        raw = self.pool[spread(self.first[ids], sizes)].tobytes()
        ends = np.concatenate(([0], np.cumsum(sizes)))[np.concatenate(([0], np.cumsum(lengths)))].tolist()
        # the first byte is the space that encoding puts before a text
        return [raw[a + 1 : b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:], strict=True)]


def decode(rows: DataFrame, model: str = MODEL, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """Adds the text of each row's ids. It is the encoded text, but for U+2581, which becomes a space. Null ids give null."""
    pieces = Pieces.read(model)

    def start():
        own = Decoder(pieces)

        def make(lists: pa.Array) -> list[pa.Array]:
            ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            found = zip(own.texts(sizes, ids), lists.is_valid().to_pylist(), strict=True)
            return [pa.array([t if valid else None for t, valid in found], pa.string())]

        return make

    return by_blocks(rows, ids_col, f"`{text_col}` string", start)


def encoded_and_checked(docs: DataFrame, model: str = MODEL, text_col: str = "text") -> DataFrame:
    """docs without text, with ids and n_tokens (see encode), and round_trip: whether the ids decode to the text again (null
    counts as empty). Texts are decoded and compared where they are encoded, so neither ids nor texts travel for it. All
    other columns stay; those of the results' names are replaced."""
    pieces = Pieces.read(model)
    opened = dictionary(docs.select(column(text_col).alias("text")), pieces)

    def start():
        known, own = opened(), Decoder(pieces)

        def make(rows: pa.Array) -> list[pa.Array]:
            texts = rows.to_pylist()
            sizes, ids = known.encode(texts)
            same = [t == (text or "") for t, text in zip(own.texts(sizes, ids), texts, strict=True)]
            return [*lists_of(sizes, ids), pa.array(same, pa.bool_())]

        return make

    return by_blocks(docs, text_col, "ids array<int>, n_tokens long, round_trip boolean", start, (text_col,))
