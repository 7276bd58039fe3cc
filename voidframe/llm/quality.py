"""A quality classifier by positive-unlabelled learning.

Trusted positives are documents labelled 1; the unlabelled web text is documents without a label. A small network over counts of
the whole text minimises the non-negative unbiased risk

    prior * E_p[loss(+)] + max(0, E_u[loss(-)] - prior * E_p[loss(-)])

with the logistic loss; where the second part falls below zero, the step goes against it. The class prior is estimated as
the share of 1 among the labels it may learn from, or, where these hold no 0, by where the scores of held-back positives lie
among the unlabelled. Both samples are bounded (`most` rows, drawn by hash); every document is scored.

Null text counts as empty and has the score of an empty text. Without a labelled positive every score is the prior, 0.5.
Repeated rows score alike; a null doc_id is kept and never learnt from.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_of

_CLASSES = [
    (lambda c: 65 <= c <= 90),  # capitals
    (lambda c: 97 <= c <= 122),
    (lambda c: 48 <= c <= 57),
    (lambda c: c == 10),
    (lambda c: c in (9, 13, 32)),
    (lambda c: c in (33, 63)),
    (lambda c: c in (44, 46, 58, 59)),
    (lambda c: c in (34, 39, 40, 41, 45)),
    (lambda c: c in (60, 61, 62, 123, 124, 125, 91, 92, 93, 47, 94, 95, 96, 126)),
    (lambda c: c in (35, 36, 37, 38, 42, 43, 64)),
    (lambda c: c >= 128),
]
_TABLE = np.array([[float(f(c)) for f in _CLASSES] for c in range(256)])
WIDTH = len(_CLASSES) + 7


def counts(text: str) -> list[float]:
    """Shares of character classes; length; share of distinct words and lines, of words equal to the one before; word length; share of capitalised words."""
    raw = text.encode("utf-8", "replace")
    shares = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _TABLE / max(1, len(raw))
    words, lines = text.split(), text.split("\n")
    n = len(words)
    distinct = len(set(words))
    return [
        *shares,
        np.log1p(len(text)) / 10,
        np.log1p(distinct) / max(0.7, np.log1p(n)),
        distinct / max(1, n),
        sum(map(operator.eq, words, words[1:])) / max(1, n),
        len(set(lines)) / len(lines),
        (len(text) - n) / max(1, n) / 10,
        sum(map(str.istitle, words)) / max(1, n),
    ]


@dataclass
class Model:
    prior: float
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(np.clip((x - self.mean) / self.scale, -8, 8) @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -40, 40)))


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float, hidden: int = 24, epochs: int = 60, batch: int = 512, rate: float = 0.01, decay: float = 1e-4, seed: int = 5) -> Model:
    """The non-negative risk minimised by Adam."""
    rng = np.random.default_rng(seed)
    both = np.concatenate([positive, unlabelled])
    mean, scale = both.mean(0), both.std(0) + 1e-3
    p, u = (np.clip((x - mean) / scale, -8, 8) for x in (positive, unlabelled))
    par = [rng.normal(0, 1 / np.sqrt(WIDTH), (WIDTH, hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    m, v = [np.zeros_like(x) for x in par], [np.zeros_like(x) for x in par]
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    softplus = lambda z: np.logaddexp(0, z)
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(u))
        for i in range(0, len(u), batch):
            xu, xp = u[order[i : i + batch]], p[rng.integers(0, len(p), min(batch, len(p)))]
            x = np.concatenate([xp, xu])
            h = np.tanh(x @ par[0] + par[1])
            z = h @ par[2] + par[3]
            zp, zu, n = z[: len(xp)], z[len(xp) :], len(xp)
            rest = softplus(zu).mean() - prior * softplus(zp).mean()
            up, uu = -prior * sig(zp) / n, sig(zu) / len(zu)  # slope of the second part
            dz = np.concatenate([-prior * sig(-zp) / n + up, uu]) if rest >= 0 else np.concatenate([-up, -uu])
            dh = np.outer(dz, par[2]) * (1 - h**2)
            grads = [x.T @ dh, dh.sum(0), h.T @ dz, dz.sum(keepdims=True)]
            step += 1
            for k, g in enumerate(grads):
                g = g + decay * par[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g**2
                par[k] = par[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Model(prior, mean, scale, par[0], par[1], par[2], float(par[3][0]))


def _counted(docs: DataFrame, keep: list[str]) -> DataFrame:
    """keep and `_x`, the counts of the whole text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [counts(t.as_py()) for t in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(found, pa.list_(pa.float64()))], names=[*keep, "_x"])

    schema = docs.select(*keep).schema.add("_x", T.ArrayType(T.DoubleType()))
    return docs.select(*keep, text_of().alias("_text")).mapInArrow(count, schema)


def learn(docs: DataFrame, labels: DataFrame, most: int = 6000) -> Model:
    """A model from at most `most` positives and `most` unlabelled documents. Labels of rows whose crc32(doc_id) mod 4 is 2 are never read."""
    crc = F.expr("crc32(cast(cast(doc_id as string) as binary))")
    own = labels.where("doc_id is not null and quality is not null").where(crc % 4 != 2).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    seen = {r["quality"]: r["count"] for r in own.groupBy("quality").count().collect()}
    million = 1_000_000
    draw = lambda n: F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.lit(million)) < min(million, -(-million * most // max(1, n)))
    ids = docs.where("doc_id is not null")
    rows = ids.count()
    trusted = ids.join(own.where("quality = 1").where(draw(seen.get(1, 0))), "doc_id", "left_semi")
    free = ids.where(draw(rows - sum(seen.values()))).join(labels.select("doc_id"), "doc_id", "left_anti")
    p, u = (np.array([r["_x"] for r in _counted(x, ["doc_id"]).orderBy("doc_id").limit(2 * most).collect()]).reshape(-1, WIDTH) for x in (trusted, free))
    if not len(p) or not len(u):
        return Model(0.5, np.zeros(WIDTH), np.ones(WIDTH), np.zeros((WIDTH, 1)), np.zeros(1), np.zeros(1), 0.0)
    if seen.get(0):
        return train(p, u, float(np.clip(seen[1] / (seen[0] + seen[1]), 0.05, 0.98)))
    first = train(p[::2], u, 0.5)
    bound = np.quantile(first.logits(p[1::2] if len(p) > 1 else p), 0.1)
    return train(p, u, float(np.clip((first.logits(u) >= bound).mean() / 0.9, 0.05, 0.98)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score, from the whole text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([counts(t.as_py()) for t in batch.column(1)]).reshape(-1, WIDTH)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.round(shared.value.score(found), 9), pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", text_of().alias("_text")).mapInArrow(judge, docs.select("doc_id").schema.add("score", "double"))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The query's columns."""
    held_out = F.expr("crc32(cast(coalesce(cast(doc_id as string), '') as binary)) % 4 = 2")
    return score(docs, learn(docs, labels)).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
