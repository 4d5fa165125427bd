"""Helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import ctypes
import re
import shutil
import tempfile
import uuid
import weakref
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = re.compile(r"\w+")
#: The same words in SQL, of a column named text.
WORDS_SQL = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')"
_LOCAL: list[str] = []
_PATHS: dict[int, str] = {}


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under spark.checkpoint.dir, which driver and executors share.

    Without the setting a folder of this machine stands in for it, in local mode only (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="axialis-"))
            atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
        base = "file://" + _LOCAL[0]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: written as Parquet in the shared folder, then read again."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[id(out)] = path
    weakref.finalize(out, _PATHS.pop, id(out), None)
    return out


def few_parts(df: DataFrame, each: int = 8) -> DataFrame:
    """A small table behind a shuffle in fewer tasks and files: every `each` partitions are one task's, one after another
    (a task sorts one of them at a time), but at least four tasks a core stay.

    For each file on a local disk, without Hadoop's native library, an executor starts chmod three times; until the
    child runs, it shares the executor's memory and can be counted with all of it."""
    spark = df.sparkSession
    return df.coalesce(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // each))


def few_stored(df: DataFrame, name: str) -> DataFrame:
    """`stored`, in few files: for tables of keys and labels behind a shuffle."""
    return stored(few_parts(df), name)


def remove(spark: SparkSession, folder: str) -> None:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard(*frames: DataFrame) -> None:
    """Deletes the files of `stored` frames that nothing will read again."""
    for df in frames:
        remove(df.sparkSession, _PATHS[id(df)])


def salted_join(many: DataFrame, one: DataFrame, key: str, spread: str, how: str = "inner", salts: int = 64) -> DataFrame:
    """Join (inner or left) of rows with `one`, which has a row a key, so that a key of most rows isn't one task's.

    The distinct (key, salt) of the rows are joined first, at most `salts` a key, then the rows by both; the salt is
    a hash of the column `spread`. Rows without a key go, in a left join too."""
    rows = many.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    dealt = rows.select(key, "__salt").distinct().join(one, key, how)
    return rows.join(dealt, [key, "__salt"]).drop("__salt")


def top_keys(counts: DataFrame, key: str, number: str, total: int, share: int = 1000) -> DataFrame:
    """The keys of over a thousandth of all rows (and 1,000 rows): at most a thousand keys, by the sum of their numbers."""
    return counts.where(F.col(number) > max(share, total // share)).select(key)


def skew_join(many: DataFrame, one: DataFrame, key: str, top: DataFrame, spread: str, salts: int = 64) -> DataFrame:
    """Inner join of rows with `one`, which has few rows a key; rows of `top` keys are spread by salts, a hash of the
    column `spread`, and `one` has each of those keys' rows once a salt."""
    marked = top.withColumn("__top", F.lit(True))
    salt = F.when(F.col("__top"), F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).otherwise(0)
    every = F.when(F.col("__top"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    left = many.join(F.broadcast(marked), key, "left").withColumn("__salt", salt).drop("__top")
    right = one.join(F.broadcast(marked), key, "left").withColumn("__salt", F.explode(every)).drop("__top")
    return left.join(right, [key, "__salt"]).drop("__salt")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Texts are sent to Python workers in batches of at most so many rows; the default of 10,000 is too much for long texts."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def give_back() -> None:
    """Returns this process's freed memory to the system, where the C library can.

    A Python worker serves tasks of all stages, and what one of them has freed would stay its own beside what the
    next one allocates."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def sliced(batch: pa.RecordBatch, sizes: np.ndarray, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices whose rows' sizes add up to at most `limit`, or of one row."""
    ends, at = np.cumsum(sizes), 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def lengths(column: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def byte_chunks(batches: Iterator[pa.RecordBatch], columns: tuple[int, ...], limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of at most `limit` bytes (or one row) in the given text or binary columns; before and after, `give_back`."""
    give_back()
    for batch in batches:
        if batch.num_rows:
            yield from sliced(batch, sum(lengths(batch.column(i)) for i in columns), limit)
    give_back()


def text_chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of at most `limit` bytes of text (or one row), nulls read as empty texts; before and after, `give_back`."""
    give_back()
    for batch in batches:
        if not batch.num_rows:
            continue
        i = batch.schema.get_field_index(column)
        texts = pc.fill_null(batch.column(i).cast(pa.large_string()), "")
        yield from sliced(batch.set_column(i, column, texts), lengths(texts), limit)
    give_back()


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64) over unsigned integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def coded_words(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct lower-case words, the place in them of each word of all texts in a row, and the bounds of each text."""
    words: list[str] = []
    bounds = np.zeros(len(texts) + 1, np.int64)
    for i, text in enumerate(texts):
        words += WORD.findall(text.lower())
        bounds[i + 1] = len(words)
    coded = pa.array(words, pa.large_string()).dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False), bounds


def hashed(words: list[str]) -> np.ndarray:
    return pd.util.hash_array(np.asarray(words, dtype=object), categorize=False) if words else np.zeros(0, np.uint64)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-case words of all texts in a row, and the bounds of each text in them."""
    distinct, codes, bounds = coded_words(texts)
    return hashed(distinct)[codes], bounds


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of `size` words; a shorter text is one run, a text without words none."""
    n = np.diff(bounds)
    counts = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    ends = np.concatenate([[0], np.cumsum(counts)])
    starts = np.repeat(bounds[:-1] - ends[:-1], counts) + np.arange(ends[-1])
    last = np.repeat(bounds[1:], counts)
    out = np.zeros(len(starts), np.uint64)
    for k in range(size):
        at = starts + k
        inside = at < last
        w = np.where(inside, words[np.minimum(at, max(len(words) - 1, 0))], np.uint64(k + 1)) if len(words) else out
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + w)
    return out, ends


def filter_texts(docs: DataFrame, make, limit: int = 1 << 20) -> DataFrame:
    """The rows for whose text the judge keeps them, all columns. make() gives a task its judge: texts to booleans."""
    small_batches(docs.sparkSession)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    place = docs.columns.index("text")

    def run(batches):
        judge = make()
        both = (pa.RecordBatch.from_arrays([b.column(0), b.column(0).field(place)], ["row", "text"]) for b in batches)
        for batch in text_chunks(both, limit=limit):
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(judge(batch.column(1).to_pylist()), pa.bool_()))], ["row"])

    return packed.mapInArrow(run, packed.schema).select("row.*")
