"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Training sees a bounded sample of labelled rows; its L1 penalty leaves few weights, which go to the
executors with the scoring function.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrion.llm.common import small_batches

_WORD = re.compile(r"[^\W_]+")
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


@dataclass(frozen=True)
class Params:
    """``sample``: labelled rows to train on at most; ``bits``: log2 of the weights there may be;
    ``positive``: how much more a toxic row weighs than a clean one, being rarer."""

    sample: int = 20_000
    bits: int = 20
    epochs: int = 2
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 6.0
    l2: float = 1.0
    positive: float = 2.0


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def features(text: str | None, seen: _Hashes, bits: int) -> np.ndarray:
    """Hashed indices of all words, word pairs and pairs with one word between, repeats included."""
    w = _WORD.findall((text or "").lower())
    h = np.fromiter(map(seen.__getitem__, w), np.uint64, len(w))
    pair = (h[:-1] * _A) ^ (h[1:] * _B)
    skip = (h[:-2] * _B) ^ (h[2:] * _C)
    return ((np.concatenate([h, pair, skip]) * _A) >> np.uint64(64 - bits)).astype(np.int32)


def train(rows: list[np.ndarray], y: np.ndarray, p: Params = Params()) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights of presence features: (indices, values, bias), in the order of the rows given."""
    z, n, bias, bias_n = np.zeros(1 << p.bits), np.zeros(1 << p.bits), 0.0, 0.0
    for _ in range(p.epochs):
        for x, t in zip(rows, y, strict=True):
            zx, nx = z[x], n[x]
            w = np.where(np.abs(zx) > p.l1, -(zx - np.sign(zx) * p.l1) / ((p.beta + np.sqrt(nx)) / p.alpha + p.l2), 0.0)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35))) - t
            g *= p.positive if t else 1.0
            z[x] = zx + g - (np.sqrt(nx + g * g) - np.sqrt(nx)) / p.alpha * w
            n[x] = nx + g * g
            bias_n += g * g
            bias -= g * p.alpha / (p.beta + np.sqrt(bias_n))
    at = np.flatnonzero(np.abs(z) > p.l1)
    return at, -(z[at] - np.sign(z[at]) * p.l1) / ((p.beta + np.sqrt(n[at])) / p.alpha + p.l2), float(bias)


def fit(docs: DataFrame, labels: DataFrame, p: Params = Params(), key: str = "doc_id", text: str = "text", label: str = "toxic") -> tuple[np.ndarray, np.ndarray, float]:
    """Weights from the labelled rows (null labels and keys left out), at most ``p.sample`` of them by hash order.

    The sample's keys are broadcast (their number is bounded); its texts become features where they
    lie, and one task of bounded size trains. No labelled rows: no weights.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).cast("int").alias("y"))
    chosen = known.withColumn("rank", F.xxhash64(key)).orderBy("rank", key).limit(p.sample)
    texts = docs.select(key, text).join(F.broadcast(chosen), key)
    small_batches(docs.sparkSession)
    bits = p.bits

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = _Hashes()
        for b in batches:
            yield pd.DataFrame({"rank": b["rank"], "y": b["y"], "x": [np.unique(features(t, seen, bits)) for t in b[text]]})

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank", kind="stable")
        at, w, bias = train(list(rows["x"]), rows["y"].to_numpy(float), p)
        return pd.DataFrame({"at": np.append(at, -1), "w": np.append(w, bias)})

    sample = texts.select("rank", "y", text).mapInPandas(extract, "rank long, y int, x array<int>")
    found = sample.groupBy(F.lit(0).alias("one")).applyInPandas(learn, "at long, w double").toPandas()  # as many rows as weights
    bias = float(found["w"][found["at"] < 0].sum())
    found = found[found["at"] >= 0].sort_values("at")
    return found["at"].to_numpy(np.int64), found["w"].to_numpy(float), bias


def score_text(text: str | None, weights: np.ndarray, bias: float, seen: _Hashes, bits: int) -> float:
    """Probability that the text is toxic."""
    x = features(text, seen, bits)
    x = np.unique(x[weights[x] != 0])
    return float(1 / (1 + np.exp(-np.clip(weights[x].sum() + bias, -35, 35))))


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], p: Params = Params(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, score)`` per row; null and empty texts get the score of the bias alone."""
    small_batches(docs.sparkSession)
    at, w, bias = model
    bits, kind = p.bits, docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, seen = np.zeros(1 << bits), _Hashes()
        weights[at] = w
        for b in batches:
            s = [score_text(t.as_py(), weights, bias, seen, bits) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], [key, "score"])

    return docs.select(key, F.col(text).cast("string")).mapInArrow(run, f"`{key}` {kind}, score double")


def held_out(key):
    """Whether a row is kept from training: crc32 of its key as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def score_documents(docs: DataFrame, labels: DataFrame, p: Params = Params(), threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document; labels of held-out rows are never read."""
    model = fit(docs, labels.where(~held_out(F.col("doc_id"))), p)
    return score(docs, model, p).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
