"""Document quality by nearest-neighbour voting in a latent-semantic space.

A text's vector counts hashed three-byte strings (log counts, inverse document frequency, unit length) and a few
measures of its shape; a truncated singular value decomposition of the labelled sample turns it into DIMS latent
dimensions. Labelled vectors are broadcast (at most ROWS x DIMS floats). Every document's cosine with every one of them
is computed exactly, in blocks of documents by blocks of labelled rows, and the NEIGHBOURS largest vote with their
similarity.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinspan.llm.common import fold_is, pieces, powers, read, stage, text_buffers

#: The labelled rows that are learned from, about so many of each class by hash of doc_id: the bound of what is broadcast.
ROWS_PER_CLASS = 1500
HASHED, DIMS, NEIGHBOURS, SHARPNESS = 4096, 48, 15, 8.0
BLOCK, LABELLED_BLOCK = 1024, 2048
THRESHOLD, NEUTRAL = 0.7, 0.5
#: Weight of the shape measures against the hashed counts.
SHAPE_WEIGHT = 0.6


def raw_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of hashed three-byte strings (rows x HASHED) and shape measures (rows x 10) of data[offsets[0]:]."""
    n = len(offsets) - 1
    raw = data[offsets[0] : offsets[-1]]
    ends = offsets[1:] - offsets[0]
    size = np.diff(offsets).astype(np.float64)
    row = np.repeat(np.arange(n), np.diff(offsets))
    counts = np.zeros((n, HASHED), np.float32)
    if len(raw) >= 3:
        x = raw.astype(np.uint32)
        h = ((x[:-2] * 0x9E3779B1 + x[1:-1] * 0x85EBCA6B + x[2:] * 0xC2B2AE35) >> np.uint32(20)).astype(np.int64)
        inside = row[:-2] == row[2:]
        counts = np.bincount(row[:-2][inside] * HASHED + h[inside], minlength=n * HASHED).reshape(n, HASHED).astype(np.float32)
    kinds = np.zeros(256, np.int64)  # 0 other letters, 1 lower, 2 upper, 3 digit, 4 space, 5 line end, 6 marks of prose, 7 other marks
    kinds[ord("a") : ord("z") + 1], kinds[ord("A") : ord("Z") + 1], kinds[ord("0") : ord("9") + 1] = 1, 2, 3
    kinds[[0x20, 0x09, 0x0B, 0x0C, 0x0D]], kinds[0x0A] = 4, 5
    kinds[[c for c in range(33, 127) if not chr(c).isalnum()]] = 7
    kinds[[ord(c) for c in ".,;:'-"]] = 6
    share = np.bincount(row * 8 + kinds[raw], minlength=n * 8).reshape(n, 8) / np.maximum(size, 1)[:, None]
    # distinct words against words, by a hash of each word
    solid = ~np.isin(kinds[raw], (4, 5))
    distinct, words = np.zeros(n), np.zeros(n)
    if solid.any():
        edge = np.zeros(len(raw) + 1, bool)
        edge[offsets[:-1] - offsets[0]] = edge[ends] = True
        start = np.flatnonzero(solid & (np.r_[True, ~solid[:-1]] | edge[:-1]))
        end = np.flatnonzero(solid & (np.r_[~solid[1:], True] | edge[1:])) + 1
        began = np.zeros(len(raw), np.int64)
        began[start] = start
        within = np.arange(len(raw)) - np.maximum.accumulate(began)
        p = powers(0x9E3779B97F4A7C15, 64)
        c = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(np.where(solid, (raw.astype(np.uint64) + np.uint64(1)) * p[within % 64], np.uint64(0)), out=c[1:])
        of, word = row[start], c[end] - c[start]
        order = np.lexsort((word, of))
        of, word = of[order], word[order]
        words = np.bincount(of, minlength=n).astype(float)
        distinct = np.bincount(of[np.r_[True, (of[1:] != of[:-1]) | (word[1:] != word[:-1])]], minlength=n).astype(float)
    variety = distinct / np.maximum(words, 1) ** 0.85  # falls slowly with length in prose
    shape = np.c_[share[:, [1, 2, 3, 4, 5, 6, 7]], np.minimum(variety, 2) / 2, np.minimum(size / np.maximum(words, 1), 20) / 20, np.log1p(words) / 12]
    return counts, shape


class Space:
    """The latent space: idf of hashed strings, scale of shape measures, projection."""

    def fit(self, counts: np.ndarray, shape: np.ndarray) -> np.ndarray:
        n = len(counts)
        self.idf = np.log((n + 1) / ((counts > 0).sum(axis=0) + 1)).astype(np.float32) + 0.1
        self.mean, self.deviation = shape.mean(axis=0), shape.std(axis=0) + 1e-6
        x = self.joined(counts, shape)
        values, vectors = np.linalg.eigh(x.T @ x if x.shape[1] <= n else x @ x.T)
        keep = np.argsort(values)[::-1][: min(DIMS, len(values))]
        keep = keep[values[keep] > 1e-6]
        v = vectors[:, keep] if x.shape[1] <= n else x.T @ vectors[:, keep] / np.sqrt(values[keep])
        self.projection = np.ascontiguousarray(v, np.float32)
        return self.latent(counts, shape)

    def joined(self, counts: np.ndarray, shape: np.ndarray) -> np.ndarray:
        x = np.log1p(counts) * self.idf
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-6)
        y = np.clip((shape - self.mean) / self.deviation, -4, 4) * (SHAPE_WEIGHT / shape.shape[1] ** 0.5)
        return np.concatenate([x, y.astype(np.float32)], axis=1)

    def latent(self, counts: np.ndarray, shape: np.ndarray) -> np.ndarray:
        z = self.joined(counts, shape) @ self.projection
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-6)


def vote(z: np.ndarray, labelled: np.ndarray, label: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Similarity-weighted share of label 1 among the nearest labelled rows; weight undoes the sampling of classes."""
    k = min(NEIGHBOURS, len(labelled))
    best = np.full((len(z), 0), 0, np.float32)
    which = np.zeros((len(z), 0), np.int64)
    for a in range(0, len(labelled), LABELLED_BLOCK):
        cosine = z @ labelled[a : a + LABELLED_BLOCK].T
        top = np.argpartition(-cosine, min(k, cosine.shape[1]) - 1, axis=1)[:, :k]
        best, which = np.c_[best, np.take_along_axis(cosine, top, 1)], np.c_[which, top + a]
    top = np.argsort(-best, axis=1, kind="stable")[:, :k]
    best, which = np.take_along_axis(best, top, 1), np.take_along_axis(which, top, 1)
    w = np.exp(SHARPNESS * (best - best[:, :1])) * np.maximum(best, 1e-3) * weight[which]
    return (w * label[which]).sum(axis=1) / w.sum(axis=1)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (quality, text): the hashed counts (as bytes of float16) and shape measures."""
    for batch in batches:
        data, offsets = text_buffers(batch.column(1))
        for i, j in pieces(offsets):
            counts, shape = raw_features(data, offsets[i : j + 1])
            counts = np.minimum(counts, 60000).astype(np.float16)
            yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array([c.tobytes() for c in counts], pa.binary()), pa.array(list(shape), pa.list_(pa.float64()))], ["quality", "counts", "shape"])


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Space, np.ndarray, np.ndarray, np.ndarray] | None:
    labels = labels.filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sizes = {r["quality"]: r["count"] for r in labels.groupBy("quality").count().collect()}
    if not sizes:
        return None
    rate = F.when(F.col("quality") == 1, F.lit(min(1.0, ROWS_PER_CLASS / sizes.get(1, 1)))).otherwise(F.lit(min(1.0, ROWS_PER_CLASS / sizes.get(0, 1))))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    # about ROWS_PER_CLASS rows of a class are drawn; the limit bounds what is broadcast whatever the draw
    chosen = labels.filter(draw < rate).orderBy(F.xxhash64("doc_id")).limit(3 * ROWS_PER_CLASS).select(F.col("doc_id").alias("of"), "quality")
    rows = docs.join(F.broadcast(stage(chosen, "labels")), F.col("doc_id") == F.col("of")).select(F.col("quality").cast("int").alias("quality"), "text")
    found = rows.mapInArrow(_vectors, "quality int, counts binary, shape array<double>").toArrow()
    if not found.num_rows:
        return None
    label = found["quality"].to_numpy().astype(np.float32)
    counts = np.frombuffer(b"".join(found["counts"].to_pylist()), np.float16).reshape(-1, HASHED).astype(np.float32)
    shape = np.array(found["shape"].to_pylist())
    drawn = [max(1.0, float((label == c).sum())) for c in (0, 1)]
    weight = np.where(label == 1, sizes.get(1, 0) / drawn[1], sizes.get(0, 0) / drawn[0]).astype(np.float32)
    space = Space()
    return space, space.fit(counts, shape).astype(np.float32), label, weight / weight.mean()


def _scores(model: tuple[Space, np.ndarray, np.ndarray, np.ndarray] | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.full(batch.num_rows, NEUTRAL)
            data, offsets = text_buffers(batch.column(1))
            if model is not None:
                space, labelled, label, weight = model
                for i, j in pieces(offsets):
                    for a in range(i, j, BLOCK):
                        b = min(j, a + BLOCK)
                        out[a:b] = vote(space.latent(*raw_features(data, offsets[a : b + 1])).astype(np.float32), labelled, label, weight)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.clip(out, 0.0, 1.0))], ["doc_id", "score"])

    return run


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score every whole text; learn from labels.quality of documents outside the hold-out fold.

    `docs` needs doc_id and text, `labels` doc_id and quality; other columns are ignored. Returns doc_id, held_out,
    score and predicted (score >= 0.7), a row for each row. A null text counts as empty; an empty one is scored by its
    shape like others. Labels that contradict each other count as 0. Without labels all score 0.5. A row without
    doc_id is scored but not learned from.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = fit(docs, labels.filter(~fold_is(F.col("doc_id"), 4, 2)))
    out = docs.mapInArrow(_scores(model), "doc_id long, score double")
    return out.select("doc_id", fold_is(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
