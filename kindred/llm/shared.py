"""What several operators of this subpackage use: tables, words, the shared folder, fixed-size bit sets."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space between words, as a set of characters and as a class for Java and RE2.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_CLASS = r"[\x20\x09-\x0D]"


#: Rows of an Arrow batch that are Python objects at once.
SLICE = 1000


def column(name: str) -> Column:
    """A column by its whole name, dots and all."""
    return F.col(f"`{name.replace('`', '``')}`")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of maximal runs without white space; null counts as empty."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, BLANK_CLASS + "+"))).cast("long")


def words(text: str | None) -> list[bytes]:
    """Words in UTF-8 with A-Z in lower case. bytes.lower and bytes.split know ASCII only, as the word rule does."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def sampled_texts(docs: DataFrame, picked: DataFrame, most_bytes: int) -> dict:
    """Texts of (id, text) by id, for the ids of picked (a table of bounded size), one for each id: the shortest, of equally
    long ones the least. Ids are taken in an order by hash as long as their texts have most_bytes in all, so what comes to the
    driver is bounded in rows and bytes; a text that is too large is passed over."""
    own = docs.select("id", F.coalesce("text", F.lit("")).alias("text")).withColumn("b", F.octet_length("text")).join(F.broadcast(picked.select("id")), "id")
    kept, rest = [], most_bytes
    for r in sorted(own.groupBy("id").agg(F.min("b").alias("b")).collect(), key=lambda r: (zlib.crc32(str(r.id).encode()), str(r.id))):
        if r.b <= rest:
            rest -= r.b
            kept.append((r.id, r.b))
    if not kept:
        return {}
    wanted = docs.sparkSession.createDataFrame(kept, own.select("id", "b").schema)
    found = own.join(F.broadcast(wanted), ["id", "b"]).groupBy("id").agg(F.min("text").alias("text")).collect()
    return {r.id: r.text for r in found}


def md5_key(value: Column, digits: int) -> Column:
    """The first hex digits of md5 of a value's text as a long (15 digits at most); null counts as empty."""
    return F.conv(F.substring(F.md5(F.coalesce(value.cast("string"), F.lit(""))), 1, digits), 16, 10).cast("long")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's checkpoint folder. Where none is set, a local one, if all
    tasks run in this process; ValueError on a cluster, whose executors couldn't read it."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir isn't set: driver and executors need a folder that they share")
        found = f"file://{tempfile.mkdtemp(prefix='kindred-')}"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its rows in the shared folder and no lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


class Store:
    """Files below a folder of the shared file system. Local paths are memory-mapped where they lie; files of another
    file system are first copied to the worker's own temporary folder. A copy has no name once it is mapped, so its room is
    free again when the worker lets go of it or ends, however it ends."""

    def __init__(self, uri: str):
        self.uri = uri

    @classmethod
    def new(cls, spark: SparkSession, name: str) -> Store:
        return cls(f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")

    def _at(self, name: str):
        from pyarrow import fs

        uri = self.uri if ":/" in self.uri else f"file://{self.uri}"
        system, path = fs.FileSystem.from_uri(uri if not uri.startswith("file:/") or uri.startswith("file://") else uri.replace("file:", "file://", 1))
        return system, f"{path}/{name}" if name else path

    def save(self, name: str, values: np.ndarray) -> None:
        """A task that is run again replaces the file by an equal one; readers never see half of it."""
        system, path = self._at(name)
        system.create_dir(os.path.dirname(path), recursive=True)
        with system.open_output_stream(draft := f"{path}.{uuid.uuid4().hex}") as f:
            f.write(np.ascontiguousarray(values).tobytes())
        system.move(draft, path)

    def load(self, name: str, dtype) -> np.ndarray:
        from pyarrow import fs

        system, path = self._at(name)
        if not system.get_file_info(path).size:
            return np.empty(0, dtype)
        if isinstance(system, fs.LocalFileSystem):
            return np.memmap(path, dtype, "r")
        with tempfile.TemporaryDirectory() as own:
            fs.copy_files(path, f"{own}/copy", source_filesystem=system)
            return np.memmap(f"{own}/copy", dtype, "r")

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """df, written as Parquet and read again."""
        df.write.parquet(f"{self.uri}/{name}", compression="zstd")
        return df.sparkSession.read.schema(df.schema).parquet(f"{self.uri}/{name}")

    def drop(self, name: str) -> None:
        """Deletes a table."""
        system, path = self._at(name)
        with contextlib.suppress(OSError):
            system.delete_dir(path)

    def delete_at_exit(self) -> None:
        """For files that a result needs whenever it is read."""
        atexit.register(self.delete)

    def delete(self) -> None:
        self.drop("")


def with_columns(df: DataFrame, inputs: list[str], added: str, make: Callable[..., Iterable[tuple]], dropped: tuple[str, ...] = ()) -> DataFrame:
    """df without the dropped columns, with more (a DDL string), row by row: make gets a list for each input and yields a
    tuple for each row. Runs on Arrow batches, so longs beside nulls stay exact. Columns of df with the names of added ones
    (in any case of letters) are replaced; all others stay, whatever their names are."""
    new = T._parse_datatype_string(added)

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in new.fields]
        for batch in (b.slice(at, SLICE) for b in batches for at in range(0, max(1, b.num_rows), SLICE)):
            made = list(make(*(batch.column(i).to_pylist() for i in range(len(inputs)))))
            columns = list(zip(*made, strict=True)) if made else [[] for _ in kinds]
            yield batch.columns[len(inputs) :], [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]

    return in_arrow(df, inputs, new, run, dropped)


def small_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches have SLICE rows at most. Executors hold a batch several times, also outside of
    the heap, in buffers of twice its size that they keep long after; of whole texts, ten thousand rows are a lot."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= SLICE:
        spark.conf.set(name, str(SLICE))


def in_arrow(df: DataFrame, inputs: Iterable[str], new: T.StructType, run: Callable, dropped: tuple[str, ...] = ()) -> DataFrame:
    """df without the dropped columns and those with names of new ones, and with the new ones. run gets Arrow batches, inputs
    first, and yields arrays of the columns that stay and of the new ones. Columns have plain names on the way, as names with
    dots aren't found there."""
    small_batches(df.sparkSession)
    gone = {n.lower() for n in (*new.names, *dropped)}
    taken, kept = [column(c) for c in inputs], [c for c in df.columns if c.lower() not in gone]
    rows = df.select(*(c.alias(f"i{k}") for k, c in enumerate(taken)), *(column(c).alias(f"c{k}") for k, c in enumerate(kept)))
    fields = [*rows.schema.fields[len(taken) :], *(T.StructField(f"n{k}", f.dataType) for k, f in enumerate(new.fields))]

    def arrow(batches):
        import pyarrow as pa

        for stay, made in run(batches):
            yield pa.RecordBatch.from_arrays([*stay, *made], names=[f.name for f in fields])

    out = rows.mapInArrow(releasing(arrow), T.StructType(fields))
    return out.select(*(F.col(f.name).alias(n) for f, n in zip(fields, (*kept, *new.names), strict=True)))


def held(df: DataFrame, replaced: Iterable[str], **made: Column) -> DataFrame:
    """The made columns, and in "row" all columns of df but those with replaced names (in any case of letters): so no name of
    theirs can clash."""
    gone = {n.lower() for n in replaced}
    kept = [column(c).alias(c) for c in df.columns if c.lower() not in gone]
    return df.select(F.struct(*(kept or [F.lit(None).cast("boolean").alias("nothing")])).alias("row"), *(c.alias(n) for n, c in made.items()))


def released(rows: DataFrame, like: DataFrame, replaced: Iterable[str], **made: Column) -> DataFrame:
    """The columns that held() put into "row", with their names in like, and the made ones behind them."""
    gone = {n.lower() for n in (*replaced, *made)}
    kept = [F.col("row").getField(c).alias(c) for c in like.columns if c.lower() not in gone]
    return rows.select(*kept, *(c.alias(n) for n, c in made.items()))


def released_memory() -> None:
    """Gives memory that this worker no longer uses back to the system: a worker lives on for later stages, and what its
    allocators keep would count beside the memory of the next one. Where the allocator can't, nothing happens."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def releasing(run: Callable) -> Callable:
    """run, a generator over batches; its memory is given back when a task has come to its end."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            released_memory()

    return wrapped


def arrow_of(run: Callable, schema: str) -> Callable:
    """For mapInArrow: run yields pandas frames of a DDL schema."""
    kind = T._parse_datatype_string(schema)

    def arrow(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        for pdf in run(batches):
            yield pa.RecordBatch.from_pandas(pdf, schema=to_arrow_schema(kind), preserve_index=False)

    return releasing(arrow)


class Hasher(dict):
    """64-bit hashes of words, kept for words that come again."""

    def __init__(self, most: int = 250_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def __call__(self, found: list[bytes]) -> np.ndarray:
        if len(self) > self.most:
            self.clear()
        return np.fromiter(map(self.__getitem__, found), np.uint64, len(found))


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... lengths[0] of them; then those of the next."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits (a public finaliser)."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Bits:
    """A Bloom filter of a fixed number of bits over 64-bit keys, filled by executors. What it sends to the driver is its
    words, not the keys, so a given size is never exceeded; too many keys only raise the rate of false hits."""

    PROBES = 3

    def __init__(self, log2: int, filled: np.ndarray | None = None):
        self.log2, self.filled = log2, filled

    def places(self, keys: np.ndarray) -> list[np.ndarray]:
        h = mixed(keys)
        step = (h >> np.uint64(32)) | np.uint64(1)
        return [(h + np.uint64(i) * step) & np.uint64((1 << self.log2) - 1) for i in range(self.PROBES)]

    def holds(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), bool)
        for at in self.places(keys):
            found &= (self.filled[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return found

    def fill(self, keys: DataFrame) -> Bits:
        """Of a DataFrame with one long column."""
        name, places = keys.columns[0], self.places

        def words_of(batches):
            for pdf in batches:
                at = np.unique(np.concatenate(places(pdf[name].to_numpy(np.int64).view(np.uint64))) if len(pdf) else np.empty(0, np.uint64))
                word, first = np.unique(at >> np.uint64(6), return_index=True)
                if len(word):
                    yield pd.DataFrame({"word": word.astype(np.int64), "bits": np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first).view(np.int64)})

        def packed(batches):
            for pdf in batches:
                yield pd.DataFrame({"words": [pdf["word"].to_numpy(np.int64).tobytes()], "bits": [pdf["bits"].to_numpy(np.int64).tobytes()]})

        filled = np.zeros(max(1, 1 << self.log2 >> 6), np.uint64)
        found = keys.mapInPandas(releasing(words_of), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
        for r in found.mapInPandas(releasing(packed), "words binary, bits binary").collect():
            filled[np.frombuffer(r.words, np.int64)] = np.frombuffer(r.bits, np.uint64)
        return Bits(self.log2, filled)
