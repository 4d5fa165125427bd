"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text (null: empty) are its words, neighbouring word pairs and pairs with one word between, and the
stems (first STEM letters) of longer words, each also as seen TIMES times or more, which stand for inflected and
compound words; all are hashed into 2**BITS places. Apart from that a feature counts once however often it occurs,
so a long text is judged as a short one is. FTRL keeps a learning rate for each coordinate, and its L1 term leaves most weights at 0: only
the others travel with the tasks, at most 2**BITS of them, whatever the corpus holds. A feature enters the model
once LEAST of the rows it learns from have it (FTRL's feature inclusion), else rare words are learned by heart.

The model is learned from at most TRAIN_ROWS labelled rows, those with the smallest hashes of their ids, while their
features are at most TRAIN_BYTES, so the choice is the same in each run. Defined cases: an empty text gets the score of the bias alone; without
any labelled row every score is 0; repeated rows are scored alike; a null doc_id is scored, not learned from.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import coded_words, filter_texts, hashed, mix64, text_chunks

BITS = 20
TRAIN_ROWS = 12_000
TRAIN_BYTES = 128 << 20
EPOCHS = 10
LEAST = 5
STEM = 5
TIMES = (2, 4)


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature places and the row of each, in no order and with repeats."""
    distinct, codes, bounds = coded_words(texts)
    words = hashed(distinct)[codes]
    row = np.repeat(np.arange(len(texts)), np.diff(bounds))
    places, rows = [mix64(words)], [row]
    stems = {w: i for i, w in enumerate(dict.fromkeys(w[:STEM] for w in distinct if len(w) > STEM))}
    if stems:
        own = np.array([stems[w[:STEM]] if len(w) > STEM else -1 for w in distinct], np.int64)[codes]
        pair, n = np.unique((row * len(stems) + own)[own >= 0], return_counts=True)
        keys = mix64(hashed(list(stems)))[pair % len(stems)]
        for k, least in enumerate((1, *TIMES)):
            places.append(mix64(keys + np.uint64(k + 1))[n >= least])
            rows.append(pair[n >= least] // len(stems))
    for gap, salt in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F)):
        if len(words) > gap:
            same = row[gap:] == row[:-gap]
            pair = mix64(words[:-gap] * np.uint64(salt) + words[gap:])
            places.append(pair[same])
            rows.append(row[:-gap][same])
    return (np.concatenate(places) >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate(rows)


class Ftrl:
    """FTRL-proximal with a rate for each coordinate."""

    def __init__(self, size: int, alpha: float = 2.0, beta: float = 1.0, l1: float = 10.0, l2: float = 0.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = sigmoid(w.sum()) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def bucket(remainders: int):
    """crc32 of the id as text, modulo `remainders`."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % remainders


def labelled_sample(labels: DataFrame, label: str, keep, rows: int) -> DataFrame:
    """At most `rows` distinct ids with their label; a label of 1 wins where an id has several."""
    own = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & keep)
    own = own.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    return own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def encoded(docs: DataFrame, ids: DataFrame, encode, limit: int) -> DataFrame:
    """doc_id, y, feats of the rows of `ids` (doc_id, y) in order of their hashes, while feats is at most `limit` bytes.

    encode(texts) gives the features of each text of a chunk as bytes, which may be packed, and their sizes unpacked,
    which the limit is for; of rows with one id the least are taken."""

    def run(batches):
        for batch in text_chunks(batches):
            feats, sizes = encode(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(feats, pa.binary()), pa.array(sizes, pa.int64())], ["doc_id", "y", "feats", "size"])

    picked = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", "y", "text")
    schema = T.StructType([picked.schema["doc_id"], T.StructField("y", T.IntegerType()), T.StructField("feats", T.BinaryType()), T.StructField("size", T.LongType())])
    one = picked.mapInArrow(run, schema).groupBy("doc_id").agg(F.max("y").alias("y"), F.min(F.struct("feats", "size")).alias("f")).select("doc_id", "y", "f.*")
    order = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    return one.withColumn("used", F.sum("size").over(order)).where(F.col("used") <= limit).select("doc_id", "y", "feats", "size")


def packed(places: np.ndarray) -> bytes:
    """Ascending places as deflated differences."""
    return zlib.compress(np.diff(places, prepend=0).astype("<u4").tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(data), "<u4"), dtype=np.int32)


def _places(texts: pa.Array) -> tuple[list[bytes], list[int]]:
    places, rows = features(texts.to_pylist())
    key = np.unique(rows << BITS | places)
    ends = np.searchsorted(key, np.arange(len(texts) + 1) << BITS)
    flat = (key & ((1 << BITS) - 1)).astype(np.int32)
    return [packed(flat[a:b]) for a, b in zip(ends, ends[1:], strict=False)], (4 * np.diff(ends)).tolist()


def train(docs: DataFrame, labels: DataFrame, keep, rows: int = TRAIN_ROWS, epochs: int = EPOCHS, least: int = LEAST, limit: int = TRAIN_BYTES) -> tuple[np.ndarray, np.ndarray, float] | None:
    """Places of the nonzero weights, the weights and the bias; None without labelled rows."""
    table = encoded(docs, labelled_sample(labels, "toxic", keep, rows), _places, limit).toArrow()
    if not table.num_rows:
        return None
    table = table.sort_by("doc_id")
    bias = 1 << BITS
    label, feats = table["y"].to_pylist(), table["feats"]
    count = np.zeros(bias, np.int32)
    for f in feats:
        count[unpacked(f.as_buffer())] += 1
    seen = count >= least
    rows_ = []
    for i in np.random.RandomState(7).permutation(len(label)):
        f = unpacked(feats[int(i)].as_buffer())
        rows_.append((np.append(f[seen[f]], np.int32(bias)), label[i]))
    del table, feats
    model = Ftrl(bias + 1)
    for _ in range(epochs):
        for at, y in rows_:
            model.learn(at, y)
    w = model.weights(np.arange(bias + 1))
    at = np.flatnonzero(w[:bias])
    return at, w[at].astype(np.float32), float(w[bias])


def scorer(model):
    """A function from texts to their scores, for one task."""
    dense = np.zeros(1 << BITS, np.float32)
    if model:
        dense[model[0]] = model[1]

    def score(texts: list[str]) -> np.ndarray:
        if not model:
            return np.zeros(len(texts))
        places, rows = features(texts)
        used = dense[places] != 0
        key = np.unique(rows[used] << BITS | places[used])
        return sigmoid(np.bincount(key >> BITS, dense[key & ((1 << BITS) - 1)], minlength=len(texts)) + model[2])

    return score


def toxicity_scores(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted of each row; rows of fold `held` are never learned from."""
    model = train(docs, labels, bucket(folds) != held)

    def run(batches):
        score = scorer(model)
        for batch in text_chunks(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score(batch.column(1).to_pylist()))], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return out.select("doc_id", F.coalesce(bucket(folds) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows that the model doesn't reject, all columns."""
    model = train(docs, labels, bucket(5) != 0)

    def make():
        score = scorer(model)
        return lambda texts: (score(texts) < threshold).tolist()

    return filter_texts(docs, make)
