"""Language identification by error-correcting output codes over hashed character n-grams.

Each language gets a codeword; one binary classifier per bit (logistic, on hashed 1-, 2- and 3-grams) predicts it; a
text gets the language whose codeword has the least loss, each bit's loss weighted by how well that bit was learnt. A
small distance between the best two is flagged as ambiguous.

Fitting: at most `sample` labelled rows in all (`per_class` a language at most), picked by a hash of the id after the languages
have been counted over all rows. Executors turn them into feature vectors of 3 x 1,024 numbers; the driver fits on
those. Prediction is one pass over whole texts without a shuffle.

Features look at letters only (other characters are one blank), lower-cased, so punctuation and digits carry nothing.

Defined results: a null text or one without a letter is `und` with score 0; where nothing was learnt all is `und`; with
one language learnt all other texts get it with score 1. Rows are never merged or dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import crc_of_id, parts_of, table

DIM = 1024
ORDERS = (1, 2, 3)
#: Odd multipliers for hashing code points. Fixed values.
MIX = np.array([2654435761, 2246822519, 3266489917], dtype=np.uint32)
_CHUNK = 1 << 16
_BLANK = 32
_LETTERS = np.array([chr(i).isalpha() for i in range(0x33000)], dtype=bool)


def features(text: str | None) -> np.ndarray | None:
    """Square roots of n-gram shares, each order of unit length; None if there is no letter. Counted in pieces of bounded size."""
    if not text:
        return None
    counts = np.zeros((len(ORDERS), DIM), dtype=np.int64)
    letters = 0
    for start in range(0, len(text), _CHUNK):
        points = np.frombuffer(text[max(0, start - 2) : start + _CHUNK].lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        known = _LETTERS[np.minimum(points, len(_LETTERS) - 1)]
        letters += int(known.sum())
        points = np.where(known, points, np.uint32(_BLANK))
        points = points[np.concatenate(([True], (points[1:] != _BLANK) | (points[:-1] != _BLANK)))]
        for k in ORDERS:
            if len(points) < k:
                continue
            h = np.zeros(len(points) - k + 1, dtype=np.uint32)
            for j in range(k):
                h ^= (points[j : len(points) - k + 1 + j] + np.uint32(j * 0x9E37)) * MIX[j]
            h ^= h >> np.uint32(15)
            counts[k - 1] += np.bincount((h * MIX[0]) >> np.uint32(22), minlength=DIM)
    if not letters:
        return None
    shares = np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1))
    return shares.ravel().astype(np.float32)


def codewords(classes: int, seed: int = 5) -> np.ndarray:
    """classes x bits of +-1: the exhaustive code up to 6 classes, else the random code of the largest least distance of 50."""
    if classes <= 6:
        bits = [[(column >> (classes - 2 - r)) & 1 if r < classes - 1 else 0 for r in range(classes)] for column in range(1, 2 ** (classes - 1))]
        return np.array(bits, dtype=np.float64).T * 2 - 1
    rng, best, least = np.random.default_rng(seed), None, -1
    for _ in range(50):
        code = rng.choice([-1.0, 1.0], size=(classes, int(np.ceil(10 * np.log2(classes)))))
        code = code[:, np.abs(code.sum(axis=0)) < classes]
        apart = ((code.shape[1] - code @ code.T) / 2 + np.eye(classes) * code.shape[1]).min()
        if apart > least:
            best, least = code, apart
    return best


def fit(x: np.ndarray, y: np.ndarray, classes: list[str], rounds: int = 120, penalty: float = 1e-5) -> dict:
    """One logistic classifier a bit, all at once, by accelerated gradient steps; classes weigh alike."""
    code = codewords(len(classes))
    signs = code[y]
    weight = (1.0 / np.bincount(y, minlength=len(classes))[y] / len(classes)).astype(np.float32)[:, None]
    x = np.hstack([x, np.ones((len(x), 1), dtype=np.float32)])
    w = np.zeros((x.shape[1], code.shape[1]), dtype=np.float32)
    back, step = w, np.float32(4.0 / (len(ORDERS) + 1))
    for i in range(rounds):
        ahead = w + np.float32(i / (i + 3)) * (w - back)
        slope = -signs / (1 + np.exp(np.clip(signs * (x @ ahead), -30, 30)))
        back, w = w, ahead - step * (x.T @ (weight * slope).astype(np.float32) + np.float32(penalty) * ahead)
    right = (weight * (signs * (x @ w) > 0)).sum(axis=0)
    return {"classes": classes, "code": code, "w": w, "trust": np.maximum(right - 0.5, 0.01), "sharp": 1.0}


def decode(model: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the nearest codeword by weighted loss, its share among all, and whether the best two are close."""
    margin = x @ model["w"][:-1] + model["w"][-1]
    trust = model["trust"] / model["trust"].sum()
    loss = (np.logaddexp(0, -margin[:, None, :] * model["code"][None]) * trust).sum(axis=2)
    share = np.exp(-(loss - loss.min(axis=1, keepdims=True)) * len(trust))
    share /= share.sum(axis=1, keepdims=True)
    top = np.sort(share, axis=1)[:, ::-1]
    return loss.argmin(axis=1), top[:, 0], (top[:, 0] - top[:, 1] < 0.2) if share.shape[1] > 1 else np.zeros(len(x), dtype=bool)


def train(rows: DataFrame, per_class: int = 800, sample: int = 4000) -> dict | None:
    """rows: t (text), y (language), r (a hash of the row, 0 to 2^31). None if there is nothing to learn from."""
    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    classes = sorted(sizes)
    if not classes:
        return None
    if len(classes) == 1:
        return {"classes": classes}
    want = max(20, min(per_class, sample // len(classes)))
    rate = F.lit(0)
    for c in classes:
        rate = F.when(F.col("y") == c, int(min(1.0, want / sizes[c]) * 2**31)).otherwise(rate)

    def to_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches):
            found = [(y, v.tobytes()) for y, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if (v := features(t)) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.binary())], names=["y", "v"])

    picked = rows.where(F.col("r") < rate).select("y", "t").mapInArrow(to_vectors, "y string, v binary").collect()
    picked.sort(key=lambda p: (p["y"], bytes(p["v"])))
    classes = sorted({p["y"] for p in picked})
    if len(classes) < 2:
        return {"classes": classes} if classes else None
    x = np.frombuffer(b"".join(bytes(p["v"]) for p in picked), dtype=np.float32).reshape(len(picked), -1)
    return fit(x, np.array([classes.index(p["y"]) for p in picked]), classes)


def identify(docs: DataFrame, model: dict | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: key, lang_pred, score, ambiguous."""

    def predict(texts: list[str | None]) -> tuple[list, list, list]:
        names, scores, unsure = ["und"] * len(texts), [0.0] * len(texts), [True] * len(texts)
        if model is None:
            return names, scores, unsure
        for start in range(0, len(texts), 256):
            found = [(i, v) for i in range(start, min(start + 256, len(texts))) if (v := features(texts[i])) is not None]
            if not found:
                continue
            if "w" in model:
                best, share, close = decode(model, np.stack([v for _, v in found]))
            else:
                best, share, close = (np.full(len(found), v) for v in (0, 1.0, False))
            for (i, _), b, s, c in zip(found, best, share, close, strict=True):
                names[i], scores[i], unsure[i] = model["classes"][b], float(s), bool(c)
        return names, scores, unsure

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches):
            names, scores, unsure = predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(unsure, pa.bool_())], names=["k", "lang_pred", "score", "ambiguous"])

    slim = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    kind = slim.schema["k"].dataType.simpleString()
    return slim.mapInArrow(apply, f"k {kind}, lang_pred string, score double, ambiguous boolean").withColumnRenamed("k", key)


def labelled(docs: DataFrame, learn: Column) -> DataFrame:
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(11)), F.lit(2**31))
    return docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("text").alias("t"), F.col("lang").alias("y"), place.alias("r"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.pmod(crc_of_id(), F.lit(3)) == 1
    model = train(labelled(docs, ~held))
    found = identify(docs, model)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "ambiguous")
