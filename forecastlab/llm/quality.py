"""A quality classifier by attention-based multiple-instance learning over the passages of a document."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Words in a passage, hashed byte pairs in its encoding, and all its features.
PASSAGE, HASHED = 64, 48
#: Classes of bytes: counts of each are features. Bytes of multi-byte code points are one class.
_CLASSES = [range(97, 123), range(65, 91), range(48, 58), b" ", b"\n\r\t\x0b\x0c", b".", b",", b"!?", b"#$%&*@^~+=", b"|\\/<>[]{}_", b"\"'`:;()-", range(128, 256)]
_CLASS = np.full(256, len(_CLASSES), dtype=np.int64)
for _i, _members in enumerate(_CLASSES):
    _CLASS[list(_members)] = _i
WIDE = len(_CLASSES) + 1
FEATURES = WIDE + HASHED + 6


def passages(text: str) -> np.ndarray:
    """A row of features for each passage of PASSAGE words of a whole text; one row of zeros for a text without words."""
    raw = text.encode()
    data, words = np.frombuffer(raw, dtype=np.uint8), [w.decode() for w in raw.split()]  # at the six ASCII white-space characters, as begins
    white = (data == 32) | ((data >= 9) & (data <= 13))
    begins = np.flatnonzero(~white & np.concatenate([[True], white[:-1]]))
    n = max(1, -(-len(begins) // PASSAGE))
    if len(begins) == 0:
        return np.zeros((1, FEATURES), dtype=np.float32)
    mark = np.zeros(len(data) + 1, dtype=np.int64)
    mark[begins[PASSAGE::PASSAGE]] = 1
    where = np.cumsum(mark[:-1])
    length = np.bincount(where, minlength=n).astype(np.float64)
    counts = np.bincount(where * WIDE + _CLASS[data], minlength=n * WIDE).reshape(n, WIDE) / length[:, None]
    low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.int64)
    pair = (low[:-1] * 37 + low[1:]) % HASHED if len(low) > 1 else np.zeros(0, dtype=np.int64)
    hashed = np.bincount(where[: len(pair)] * HASHED + pair, minlength=n * HASHED).reshape(n, HASHED) / length[:, None]
    more = np.zeros((n, 6))
    for k in range(n):
        here = words[k * PASSAGE : (k + 1) * PASSAGE]
        m = len(here)
        more[k] = (len(set(here)) / m, sum(map(str.__eq__, here, here[1:])) / m, min(length[k] / m, 40) / 10, min(max(map(len, here)), 60) / 20, m / PASSAGE, sum(map(str.isupper, here)) / m)
    return np.concatenate([counts * 4, np.sqrt(hashed), more], axis=1).astype(np.float32)


@dataclass
class Model:
    """h = tanh(x A + a); attention = softmax of (tanh(h V) * sigmoid(h U)) w; score = sigmoid(attention-weighted h . c + b)."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def scores(self, bags: list[np.ndarray]) -> np.ndarray:
        sizes = np.array([len(b) for b in bags])
        x = (np.concatenate(bags) - self.mean) / self.scale
        return _forward(self.weights, x, np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)["p"]


def _forward(w: dict[str, np.ndarray], x: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> dict[str, np.ndarray]:
    h = np.tanh(x @ w["A"] + w["a"])
    v, u = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
    e = (v * u) @ w["w"]
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, at), sizes))
    g = e / np.repeat(np.add.reduceat(e, at), sizes)
    z = np.add.reduceat(g[:, None] * h, at, axis=0)
    return {"h": h, "v": v, "u": u, "g": g, "z": z, "p": 1 / (1 + np.exp(-np.clip(z @ w["c"] + w["b"], -30, 30)))}


def _gradients(w: dict[str, np.ndarray], x: np.ndarray, at: np.ndarray, sizes: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    f = _forward(w, x, at, sizes)
    error = (f["p"] - y) / len(y)
    dz = np.repeat(error, sizes)[:, None] * w["c"][None, :]
    dg = (dz * f["h"]).sum(axis=1)
    de = f["g"] * (dg - np.repeat(np.add.reduceat(f["g"] * dg, at), sizes))
    dv = de[:, None] * w["w"] * f["u"] * (1 - f["v"] ** 2)
    du = de[:, None] * w["w"] * f["v"] * f["u"] * (1 - f["u"])
    dh = (f["g"][:, None] * dz + dv @ w["V"].T + du @ w["U"].T) * (1 - f["h"] ** 2)
    return {"A": x.T @ dh, "a": dh.sum(axis=0), "V": f["h"].T @ dv, "U": f["h"].T @ du, "w": (f["v"] * f["u"]).T @ de, "c": f["z"].T @ error, "b": np.array(error.sum())}


def fit(bags: list[np.ndarray], labels: np.ndarray, hidden: int = 16, gate: int = 8, epochs: int = 12, batch: int = 64, rate: float = 5e-3, decay: float = 1e-4, seed: int = 5) -> Model:
    """A model fitted to labelled bags of passages by seeded mini-batch Adam. Without both labels it scores their smoothed share."""
    rng, y = np.random.default_rng(seed), np.asarray(labels, dtype=float)
    x = np.concatenate(bags) if bags else np.zeros((1, FEATURES), dtype=np.float32)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 0.05
    w = {k: rng.normal(0, 1 / np.sqrt(s[0]), s) for k, s in {"A": (FEATURES, hidden), "V": (hidden, gate), "U": (hidden, gate), "w": (gate,), "c": (hidden,)}.items()} | {"a": np.zeros(hidden), "b": np.array(0.0)}
    share = (y.sum() + 1) / (len(y) + 2)
    w["b"] = np.array(np.log(share / (1 - share)))
    if len(set(y.tolist())) < 2:
        w["c"] = np.zeros(hidden)
        return Model(mean, scale, w)
    first, second, step = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    scaled = [(b - mean) / scale for b in bags]
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        for k in range(0, len(order), batch):
            chosen = order[k : k + batch]
            sizes = np.array([len(scaled[i]) for i in chosen])
            got = _gradients(w, np.concatenate([scaled[i] for i in chosen]), np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes, y[chosen])
            step += 1
            for name, d in got.items():
                d = d + decay * w[name]
                first[name] = 0.9 * first[name] + 0.1 * d
                second[name] = 0.999 * second[name] + 0.001 * d * d
                w[name] = w[name] - rate * (0.5 if epoch >= epochs * 2 // 3 else 1) * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, w)


def held_out(doc_id: str) -> Column:
    """Whether a document's label is kept from learning: crc32 of its id as text is a multiple of 5. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, sample: int = 4000) -> Model:
    """Fits on at most `sample` labelled documents that are not held out, those with the least hash of doc_id.

    The sample is the documented bound on what the driver gets: the features of its passages.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out("doc_id")).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).withColumnRenamed("doc_id", "_id")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("quality").cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 256):
                bags = [passages(t).tobytes() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(bags, pa.binary())], ["doc_id", "quality", "bag"])

    got = sorted((r["doc_id"], r["quality"], bytes(r["bag"])) for r in rows.select(F.col("doc_id").cast("long"), "text", "quality").mapInArrow(run, "doc_id long, quality int, bag binary").collect())
    return fit([np.frombuffer(b, dtype=np.float32).reshape(-1, FEATURES) for *_, b in got], np.array([q for _, q, _ in got]))


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = 4000) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, held_out, score, predicted (1 where score is at least the threshold).

    The score is of the whole text alone. A null, empty or blank text has one passage of zeros. Repeated rows have a
    row each, an empty table of documents an empty result; without labels every score is 0.5. Other columns are not
    looked at.
    """
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 128):
                scores = model.value.scores([passages(t or "") for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(scores, pa.float64())], ["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out("doc_id").alias("held_out"))
    scored = rows.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = 4000, training: DataFrame | None = None) -> DataFrame:
    """The rows of docs that score_quality does not reject, with all their columns; the text alone decides.

    The labels' texts are in training (doc_id, text), or in docs.
    """
    model = docs.sparkSession.sparkContext.broadcast(learn(docs if training is None else training, labels, sample))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 128):
                scores = model.value.scores([passages(t or "") for t in part.column(at).to_pylist()])
                yield part.filter(pa.array(scores >= threshold))

    return docs.mapInArrow(run, docs.schema)
