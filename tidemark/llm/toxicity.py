"""Toxicity by cumulative-link ordinal regression over hashed words.

P(grade > j) = sigmoid(w.x - t_j): all thresholds share the weights, and t_0 < t_1 < ... by
construction. The expected severity is the sum of these probabilities. x has 1 for each hashed word of
the text. The fit takes a bounded sample of labelled rows to the driver; scoring reads every text once
and needs only the weights that are not zero.

Edge cases: NULL and empty texts have no words and get the severity of the thresholds alone; labels
without a document, or NULL, are not used, and of several labels of a document the highest counts; with fewer than two grades in the sample, severity is the
one grade; other columns pass through, and columns named like the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import common as C

BITS = 18
#: Bytes that are no part of a word: ASCII without letters.
OTHER = np.zeros(256, bool)
OTHER[:128] = True
OTHER[65:91] = OTHER[97:123] = False


def features(b: pa.RecordBatch, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of the distinct words of each text; only features where keep is true."""
    buf, off = C.text_bytes(b)
    buf = np.where((buf >= 65) & (buf <= 90), buf | 32, buf)
    starts, ends, woff = C.word_spans(buf, off, OTHER)
    f = (C.word_hashes(buf, starts, ends) >> np.uint64(64 - BITS)).astype(np.int64)
    row = np.repeat(np.arange(len(off) - 1), np.diff(woff))
    if keep is not None:
        sel = keep[f]
        f, row = f[sel], row[sel]
    u = np.unique(row << BITS | f)
    return u >> BITS, u & ((1 << BITS) - 1)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, row: np.ndarray, f: np.ndarray, n: int) -> np.ndarray:
        """n x thresholds: P(grade > j)."""
        z = np.bincount(row, self.weights[f], n)
        return sigmoid(z[:, None] - self.thresholds[None, :])


def fit(row: np.ndarray, f: np.ndarray, grade: np.ndarray, l2: float = 1e-3, steps: int = 250, rate: float = 0.1, min_docs: int = 3) -> OrdinalModel:
    """Adam on the likelihood of the grades, whose classes weigh the same in all. Words of fewer than
    min_docs texts get no weight."""
    k = int(grade.max()) if len(grade) else 0
    w = np.zeros(1 << BITS)
    if k < 1:
        return OrdinalModel(w, np.zeros(0))
    used = np.flatnonzero(np.bincount(f, minlength=1 << BITS) >= min_docs)
    at = np.full(1 << BITS, -1)
    at[used] = np.arange(len(used))
    sel = at[f] >= 0
    row, f = row[sel], at[f[sel]]
    n, d = len(grade), len(used)
    cls = np.bincount(grade, minlength=k + 1)
    weight = (1 / np.maximum(cls, 1))[grade] / (cls > 0).sum()
    p = np.concatenate([np.zeros(d), np.linspace(0, 1, k)[:1], np.zeros(k - 1)])  # weights, t_0, logs of the steps
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, steps + 1):
        t = p[d] + np.concatenate([[0.0], np.cumsum(np.exp(p[d + 1 :]))])
        z = np.bincount(row, p[f], n)
        above = np.concatenate([np.ones((n, 1)), sigmoid(z[:, None] - t[None, :]), np.zeros((n, 1))], 1)
        i = np.arange(n)
        pr = np.maximum(above[i, grade] - above[i, grade + 1], 1e-12)
        slope = above * (1 - above)
        gt = np.zeros((n, k))  # d log-likelihood by each threshold
        lo, hi = grade > 0, grade < k
        gt[i[lo], grade[lo] - 1] -= slope[i[lo], grade[lo]] / pr[lo]
        gt[i[hi], grade[hi]] += slope[i[hi], grade[hi] + 1] / pr[hi]
        gt *= weight[:, None]
        gz = -gt.sum(1)
        col = gt.sum(0)
        tail = np.cumsum(col[::-1])[::-1]
        g = -np.concatenate([np.bincount(f, gz[row], d), [col.sum()], tail[1:] * np.exp(p[d + 1 :])])
        g[:d] += l2 * p[:d]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    w[used] = np.where(np.abs(p[:d]) > 1e-3, p[:d], 0.0)
    return OrdinalModel(w, p[d] + np.concatenate([[0.0], np.cumsum(np.exp(p[d + 1 :]))]))


def gather(docs: DataFrame, graded: DataFrame, sample: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, grade) of about ``sample`` documents of graded (doc_id, grade), by a hash of doc_id."""
    some = graded.where("doc_id IS NOT NULL AND grade IS NOT NULL").groupBy("doc_id").agg(F.max("grade").alias("grade")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    d = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")  # sample bounds its size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.pieces(batches):
            row, f = features(b)
            off = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=b.num_rows))])
            yield pa.RecordBatch.from_arrays([C.column(b, "grade"), pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(f, pa.int32()))], names=["grade", "f"])

    t = d.mapInArrow(run, "grade int, f array<int>").toArrow()
    lists = t.column("f").combine_chunks()
    n = pc.list_value_length(lists).to_numpy(zero_copy_only=False) if len(lists) else np.zeros(0, np.int64)
    return np.repeat(np.arange(len(n)), n), lists.flatten().to_numpy().astype(np.int64) if len(lists) else np.zeros(0, np.int64), t.column("grade").to_numpy().astype(np.int64)


def intensity_grades(row: np.ndarray, f: np.ndarray, toxic: np.ndarray, words: int = 200) -> np.ndarray:
    """0 for texts that are not toxic; the toxic ones are 1 or 2 by how many of the words that tell
    toxic texts best they hold: above the median of toxic texts, or not."""
    nf = 1 << BITS
    a, b = np.bincount(f[toxic[row] == 1], minlength=nf), np.bincount(f[toxic[row] == 0], minlength=nf)
    na, nb = max(1, (toxic == 1).sum()), max(1, (toxic == 0).sum())
    lift = np.where(a >= 3, np.log((a + 0.5) / na) - np.log((b + 0.5) / nb), -np.inf)
    best = np.argsort(-np.where(a >= 3, lift, -1e9) * np.sqrt(np.maximum(a, 1)))[:words]
    mark = np.zeros(nf, bool)
    mark[best[lift[best] > 1.0]] = True
    held = np.bincount(row[mark[f]], minlength=len(toxic))
    return np.where(toxic == 0, 0, np.where(held > np.median(held[toxic == 1]) if (toxic == 1).any() else False, 2, 1))


def predict(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """docs with severity (expected grade), grade (the likeliest) and toxic (P(grade > 0) >= 1/2)."""
    docs = docs.drop("severity", "grade", "toxic")
    names = docs.columns
    sparse = np.flatnonzero(model.weights)
    values, thresholds = model.weights[sparse], model.thresholds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.zeros(1 << BITS)
        w[sparse] = values
        m = OrdinalModel(w, thresholds)
        for b in C.pieces(batches):
            above = m.above(*features(b, w != 0), b.num_rows)
            p = -np.diff(np.concatenate([np.ones((b.num_rows, 1)), above, np.zeros((b.num_rows, 1))], 1), axis=1)
            toxic = above[:, 0] >= 0.5 if above.shape[1] else np.zeros(b.num_rows, bool)
            yield pa.RecordBatch.from_arrays([*[C.column(b, n) for n in names], pa.array(above.sum(1)), pa.array(p.argmax(1), pa.int32()), pa.array(toxic)], names=[*names, "severity", "grade", "toxic"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("severity", T.DoubleType()), T.StructField("grade", T.IntegerType()), T.StructField("toxic", T.BooleanType())]))


def train(docs: DataFrame, labels: DataFrame, sample: int = 12_000) -> OrdinalModel:
    """From labels (doc_id, toxic 0/1)."""
    row, f, toxic = gather(docs, labels.select("doc_id", F.col("toxic").cast("int").alias("grade")), sample)
    return fit(row, f, intensity_grades(row, f, toxic))


def query(spark, sf_dir: str) -> DataFrame:
    d = C.documents(spark, sf_dir).select("doc_id", "text")
    return predict(d, train(d, C.table(spark, sf_dir, "labels"))).drop("text")
