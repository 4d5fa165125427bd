"""Quality scores by attention-based multiple-instance learning.

A text (null: empty) is a bag of passages of PASSAGE bytes, the last one shorter. A passage is encoded from the
square roots of the shares of its bytes and hashed byte pairs and of words that repeat the word before, through a learned layer of width HIDDEN; gated
attention weights a = softmax(w . (tanh(V h) * sigmoid(U h))) are learned from document labels alone, and the
score is a logistic function of the weighted sum of passages.

A text is encoded in parts of PART bytes, so a very long one needs memory for its passages' HIDDEN numbers only; a
word that repeats the last one of the part before isn't counted as a repeat.

Learned from at most TRAIN_ROWS labelled rows, those with the smallest hashes of their ids, while their features are
at most TRAIN_BYTES. Scoring has no such bound and reads whole texts. Defined cases: an empty text is one passage of zeros; without labelled rows every
score is 0; repeated rows are scored alike; null ids are scored, not learned from.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_chunks
from .toxicity import bucket, encoded, labelled_sample, sigmoid

PASSAGE = 512
PAIRS = 256
WIDTH = 256 + PAIRS + 1
HIDDEN = 32
GATE = 16
TRAIN_ROWS = 3000
TRAIN_BYTES = 128 << 20
PART = 512 * PASSAGE
EPOCHS = 12


def parts(texts: pa.Array) -> tuple[list[list[bytes]], np.ndarray]:
    """The texts cut into parts, in groups of at most PART bytes, and each text's bounds in their passages."""
    groups, size, ends = [[]], 0, [0]
    for text in texts:
        data = text.as_buffer() or b""
        for at in range(0, max(1, len(data)), PART):
            part = data[at : at + PART]
            if size + len(part) > PART and groups[-1]:
                groups.append([])
                size = 0
            groups[-1].append(part)
            size += len(part)
        ends.append(ends[-1] + max(1, -(-len(data) // PASSAGE)))
    return groups, np.array(ends)


def passages(group: list[bytes]) -> np.ndarray:
    """Features of all passages of a group of parts in a row."""
    n = np.array([len(x) for x in group], np.int64)
    data = np.frombuffer(b"".join(group), np.uint8).astype(np.int64)
    count = np.maximum(1, -(-n // PASSAGE))
    bounds = np.concatenate([[0], np.cumsum(count)])
    row = np.repeat(np.arange(len(n)), n)
    inside = np.arange(len(data)) - np.repeat(np.cumsum(n) - n, n)
    at = bounds[row] + inside // PASSAGE
    total = int(bounds[-1])
    out = np.bincount(at * WIDTH + data, minlength=total * WIDTH)
    if len(data) > 1:
        same = at[1:] == at[:-1]
        pair = (data[:-1] * 31 + data[1:] * 7 + (data[:-1] * data[1:] >> 3)) % PAIRS
        out += np.bincount((at[1:] * WIDTH + 256 + pair)[same], minlength=total * WIDTH)
    gaps = np.flatnonzero(data == 32)
    if len(gaps) > 2:
        sums = np.cumsum(data * (data + 7))[gaps]
        size, weigh = np.diff(gaps), np.diff(sums)
        again = (size[1:] == size[:-1]) & (weigh[1:] == weigh[:-1]) & (size[1:] > 1) & (row[gaps[2:]] == row[gaps[:-2]])
        out += np.bincount(at[gaps[2:][again]] * WIDTH + WIDTH - 1, minlength=total * WIDTH)
    out = out.reshape(total, WIDTH).astype(np.float32)
    size = np.maximum(1, out[:, :256].sum(1, keepdims=True))
    out[:, -1] *= 6
    return np.sqrt(out / size)


def hidden(m: dict, x: np.ndarray) -> np.ndarray:
    return np.tanh(x @ m["E"] + m["e"])


def attend(m: dict, h: np.ndarray, bounds: np.ndarray) -> dict:
    v, u = np.tanh(h @ m["V"]), sigmoid(h @ m["U"])
    s = (v * u) @ m["w"]
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    s = np.exp(s - np.maximum.reduceat(s, bounds[:-1])[row])
    a = s / np.add.reduceat(s, bounds[:-1])[row]
    z = np.add.reduceat(a[:, None] * h, bounds[:-1], axis=0)
    return {"h": h, "v": v, "u": u, "a": a, "row": row, "z": z, "p": sigmoid(z @ m["c"] + m["b"])}


def gradients(m: dict, x: np.ndarray, bounds: np.ndarray, y: np.ndarray) -> dict:
    f = attend(m, hidden(m, x), bounds)
    d = (f["p"] - y) / len(y)
    dz = d[:, None] * m["c"]
    g = {"c": f["z"].T @ d, "b": np.array([d.sum()])}
    far = (dz[f["row"]] * f["h"]).sum(1)
    ds = f["a"] * (far - np.add.reduceat(f["a"] * far, bounds[:-1])[f["row"]])
    g["w"] = (f["v"] * f["u"]).T @ ds
    dv = ds[:, None] * m["w"] * f["u"] * (1 - f["v"] ** 2)
    du = ds[:, None] * m["w"] * f["v"] * f["u"] * (1 - f["u"])
    g["V"], g["U"] = f["h"].T @ dv, f["h"].T @ du
    dh = (f["a"][:, None] * dz[f["row"]] + dv @ m["V"].T + du @ m["U"].T) * (1 - f["h"] ** 2)
    g["E"], g["e"] = x.T @ dh, dh.sum(0)
    return g


def fit(bags: list[np.ndarray], y: np.ndarray, epochs: int = EPOCHS, rate: float = 0.01, seed: int = 11) -> dict:
    """Adam over mini-batches of bags."""
    rng = np.random.default_rng(seed)
    init = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    m = {"E": init(WIDTH, HIDDEN) * 3, "e": np.zeros(HIDDEN, np.float32), "V": init(HIDDEN, GATE), "U": init(HIDDEN, GATE), "w": init(GATE), "c": init(HIDDEN), "b": np.zeros(1, np.float32)}
    one, two = ({k: np.zeros_like(v) for k, v in m.items()} for _ in range(2))
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), 32):
            own = order[at : at + 32]
            bounds = np.concatenate([[0], np.cumsum([len(bags[i]) for i in own])])
            x = np.concatenate([bags[i] for i in own]).astype(np.float32)
            g, step = gradients(m, x, bounds, y[own]), step + 1
            for k in m:
                one[k] = 0.9 * one[k] + 0.1 * g[k]
                two[k] = 0.999 * two[k] + 0.001 * g[k] ** 2
                m[k] = (m[k] - rate * (one[k] / (1 - 0.9**step)) / (np.sqrt(two[k] / (1 - 0.999**step)) + 1e-8) - 1e-5 * m[k]).astype(np.float32)
    return m


def _features(texts: pa.Array) -> tuple[list[bytes], list[int]]:
    groups, bounds = parts(texts)
    x = np.concatenate([passages(g).astype(np.float16) for g in groups])
    feats = [x[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)]
    return feats, list(map(len, feats))


def train(docs: DataFrame, labels: DataFrame, keep, rows: int = TRAIN_ROWS, limit: int = TRAIN_BYTES) -> dict | None:
    table = encoded(docs, labelled_sample(labels, "quality", keep, rows), _features, limit).toPandas()
    if table.empty:
        return None
    table = table.sort_values("doc_id")
    bags = [np.frombuffer(f, np.float16).reshape(-1, WIDTH) for f in table.feats]
    return fit(bags, table.y.to_numpy(np.float32))


def quality_scores(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of each row; rows of fold `held` are never learned from."""
    model = train(docs, labels, bucket(folds) != held)

    def run(batches):
        for batch in text_chunks(batches, limit=1 << 20):
            score = np.zeros(batch.num_rows)
            if model:
                groups, bounds = parts(batch.column(1))
                h = np.concatenate([hidden(model, passages(g)) for g in groups])
                score = attend(model, h, bounds)["p"].astype(np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return out.select("doc_id", F.coalesce(bucket(folds) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
