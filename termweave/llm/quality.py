"""Quality classifier on random Fourier features (operator 3).

Document statistics are standardised and mapped to random Fourier features, which
approximate a Gaussian kernel. Ridge scores come from normal equations: each partition sums
its part of the Gram matrix, Spark adds the parts (as integers of 2**-24, so that any order
gives the same sum) and the driver solves systems of fixed size. An isotonic regression on
scores of rows that their ridge has not seen turns scores into chances of label 1; it is
fitted on at most ``BINS`` bins, each a count and a sum.

Labels are learned only from rows whose crc32(doc_id as text) mod 5 is not 0. The remainders
1 to 4 are folds: the rows of each are scored by the ridge of the other three, all these
scores fit the calibration, and the ridge of all four scores documents. That is so for any
number of rows; the four Gram matrices are summed in one pass. Only the text enters a score.

Defined results: a null text is an empty one; empty texts have statistics too and are scored;
of repeated labels of one doc_id the least quality counts, null ones and other values are
ignored; equal texts get equal scores; without labels of both kinds the score is the
smoothed share of label 1 for all; an empty table gives no rows. Other columns of the
documents are kept in the operator, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.llm.common import stage, table, unstage
from termweave.llm.words import FACTOR, word_hashes

N_STATS = 12
N_FEATURES = 160
GAMMA = 0.5 / N_STATS
RIDGE = 1e-3
SEED = 20240607
BINS = 4000
ACCEPT = 0.3
SCALE = float(1 << 24)

UPPER, DIGITS, SYMBOLS, SIGNS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&|<>", b"!=/{}_"
LOWER = b"abcdefghijklmnopqrstuvwxyz"
BLANKS = b" \t\n\x0b\x0c\r"
HIGH = bytes(range(128, 256))


def statistics(text: str) -> list[float]:
    """Statistics of a whole text."""
    data = text.encode("utf-8", "surrogatepass")
    words = word_hashes(text)
    n = len(words)
    if not n:
        return [0.0] * N_STATS

    def count(chars: bytes) -> int:
        return len(data) - len(data.translate(None, chars))

    chars = len(data) - count(BLANKS)
    upper, lower = count(UPPER), count(LOWER)
    lines = [x for x in data.split(b"\n") if x.strip()]
    ends = data.count(b". ") + data.count(b".\n") + data.endswith(b".")
    return [
        math.log1p(n),
        min(20.0, chars / n),
        upper / (upper + lower + 1),
        min(1.0, count(SYMBOLS) / n),
        min(1.0, count(SIGNS) / n),
        min(1.0, 4 * count(DIGITS) / chars),
        min(1.0, 4 * ends / n),
        len(np.unique(words)) / n,
        len(np.unique(words[1:] * FACTOR + words[:-1])) / (n - 1) if n > 1 else 1.0,
        1 - len(set(lines)) / len(lines),
        math.log1p(n / len(lines)),
        count(HIGH) / chars,
    ]


@dataclass(frozen=True)
class Model:
    """What a score needs; all of fixed size."""

    mean: np.ndarray
    std: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = fourier((x - self.mean) / self.std) @ self.weights
        return np.clip(np.interp(raw, self.knots, self.values), 0.0, 1.0)


def fourier(z: np.ndarray) -> np.ndarray:
    """Random Fourier features of standardised rows, and a bias."""
    rng = np.random.default_rng(SEED)
    w = rng.normal(scale=math.sqrt(2 * GAMMA), size=(N_STATS, N_FEATURES))
    b = rng.uniform(0, 2 * math.pi, size=N_FEATURES)
    return np.hstack([math.sqrt(2.0 / N_FEATURES) * np.cos(np.clip(z, -8, 8) @ w + b), np.ones((len(z), 1))])


def isotonic(x: np.ndarray, n: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over sorted bins (centre, rows, sum of labels); the result is
    interpolated between block centres."""
    blocks: list[list[float]] = []
    for a, k, s in zip(x, n, y):
        blocks.append([a * k, k, s])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            top = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], top)]
    return np.array([b[0] / b[1] for b in blocks]), np.array([b[2] / b[1] for b in blocks])


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5; a null id counts as 0, so it is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5, F.lit(0)).cast("int")


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, x) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id long, x array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=float).reshape(-1, N_STATS)


FOLDS = (1, 2, 3, 4)


def grams(rows: DataFrame, mean: np.ndarray, std: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The normal equations of (x, y, fold) rows by fold, summed by partition, then by Spark."""
    size = N_FEATURES + 1
    upper = np.triu_indices(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(FOLDS), size, size + 1))
        for batch in batches:
            if not batch.num_rows:
                continue
            phi, y, fold = fourier((_matrix(batch.column(0)) - mean) / std), np.asarray(batch.column(1), dtype=float), np.asarray(batch.column(2))
            for k, f in enumerate(FOLDS):
                own = phi[fold == f]
                total[k, :, :size] += own.T @ own
                total[k, :, size] += own.T @ y[fold == f]
        flat = np.rint(np.concatenate([np.concatenate([t[:, :size][upper], t[:, size]]) for t in total]) * SCALE).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["k", "v"])

    sums = rows.select("x", "y", "fold").mapInArrow(run, "k long, v long").groupBy("k").agg(F.sum(F.col("v").cast("decimal(38,0)")).cast("double").alias("v"))
    n = len(upper[0]) + size
    flat = np.zeros(n * len(FOLDS))
    for r in sums.collect():  # of fixed size
        flat[r.k] = r.v / SCALE
    out = {}
    for f, own in zip(FOLDS, flat.reshape(len(FOLDS), n)):
        g = np.zeros((size, size))
        g[upper] = own[: len(upper[0])]
        out[f] = g + np.triu(g, 1).T, own[len(upper[0]) :]
    return out


def ridge(parts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Weights from the normal equations of some folds."""
    g, r = sum(p[0] for p in parts), sum(p[1] for p in parts)
    return np.linalg.solve(g + RIDGE * max(1.0, g[-1, -1]) / N_FEATURES * np.eye(len(g)), r)


def bin_of(score: np.ndarray) -> np.ndarray:
    return np.clip(np.floor((score + 0.5) * BINS / 2), 0, BINS - 1).astype(np.int64)


def fit(statistics_of: DataFrame, labels: DataFrame) -> Model:
    """A model from (doc_id, x) and labels."""
    known = labels.where(F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("y"))
    rows = statistics_of.join(known, "doc_id").withColumn("fold", fold(F.col("doc_id"))).where("fold <> 0")
    rows = stage(rows.select("x", F.col("y").cast("double").alias("y"), "fold"), "quality-train")
    cells = [f(F.get("x", F.lit(k))).alias(f"{n}{k}") for k in range(N_STATS) for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    by = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("ones"), *cells).first()
    n, ones = by["n"], by["ones"] or 0.0
    if not 0 < ones < n:
        share = np.array([(ones + 1) / (n + 2)])
        return Model(np.zeros(N_STATS), np.ones(N_STATS), np.zeros(N_FEATURES + 1), np.zeros(1), share)
    mean = np.round([by[f"m{k}"] for k in range(N_STATS)], 6)
    std = np.maximum(1e-3, np.round([by[f"s{k}"] for k in range(N_STATS)], 6))
    parts = grams(rows, mean, std)
    others = np.array([ridge([parts[f] for f in FOLDS if f != own]) for own in FOLDS])

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = (fourier((_matrix(batch.column(0)) - mean) / std) * others[np.asarray(batch.column(2)) - FOLDS[0]]).sum(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(bin_of(score)), batch.column(1)], ["bin", "y"])

    binned = rows.select("x", "y", "fold").mapInArrow(raw, "bin long, y double").groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("s"))
    bins = sorted(binned.collect())  # BINS rows at most
    at = np.array([(b.bin + 0.5) * 2 / BINS - 0.5 for b in bins])
    knots, values = isotonic(at, np.array([float(b.n) for b in bins]), np.array([b.s for b in bins]))
    unstage(rows)
    return Model(mean, std, ridge(list(parts.values())), knots, values)


def scored(statistics_of: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) from (doc_id, x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(_matrix(batch.column(1))) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], ["doc_id", "score"])

    return statistics_of.mapInArrow(run, "doc_id long, score double")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` whose score is ACCEPT or more, with their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.array([statistics(t.as_py() or "") for t in batch.column(batch.schema.names.index("text"))])
                batch = batch.filter(pa.array(model.score(x) >= ACCEPT))
            yield batch

    return docs.mapInArrow(run, docs.schema)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = stage(features(table(spark, sf_dir, "documents")), "quality-features")
    model = fit(x, table(spark, sf_dir, "labels"))
    out = scored(x, model)
    return out.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
