"""Language ID by language-bitmask n-gram filters.

A bit-sliced Bloom filter has one word of language bits per slot: the AND of an n-gram's slots names
all languages that contain it. A document's popcount per language, less the false positives that the
fill of that language's slice predicts, decides; the score is the winner's part of all counts.

The filters are learned from all labelled rows: the most frequent n-grams of each language, without
those that another language uses far more often. Every label is learned. The size of the filter does
not grow with the corpus, only with the number of labels, so it is broadcast. ``known`` is the part
of a text's n-grams that the winner's filter holds; ``usual`` is the low quantile of it in all labelled rows.

Edge cases: NULL texts and texts without a letter are ``und`` with score 0, and so is everything if
nothing was learned; ties go to the language that comes first in the alphabet; other columns pass
through, and columns named like the results are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import common as C

UNDETERMINED = "und"
#: Bytes of the filter, above which slices get denser, down to 8 slots an n-gram.
FILTER_BYTES = 64 << 20
#: Bytes of the filter, above which slices get denser, down to 8 slots an n-gram.
FILTER_BYTES = 64 << 20
#: Counts of n-grams that a task holds before it hands them on, about.
HELD = 1 << 20
#: Steps of ``usual`` between 0 and 1.
STEPS = 10_000
LETTER = re.compile(r"[^\W\d_]")
_alpha: list[np.ndarray] = []


def alpha_table() -> np.ndarray:
    if not _alpha:
        _alpha.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _alpha[0]


def grams(texts: list[str | None], n: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the character n-grams of lower-cased letters, with one space for each other
    character and at both ends; and the offsets of texts. N-grams without a letter are left out."""
    padded = [f" {t.lower()} " if t else "" for t in texts]
    cp = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.fromiter((len(t) for t in padded), np.int64, len(padded))
    if len(cp) < n:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    letter = alpha_table()[cp]
    x = np.where(letter, cp, 32).astype(np.uint64)
    h, any_ = np.zeros(len(cp) - n + 1, np.uint64), np.zeros(len(cp) - n + 1, bool)
    for i in range(n):
        h = h * np.uint64(0x100000001B3) + x[i : len(cp) - n + 1 + i]
        any_ |= letter[i : len(cp) - n + 1 + i]
    end = np.cumsum(size)
    doc = np.repeat(np.arange(len(size)), size)[: len(h)]
    ok = any_ & (np.arange(len(h)) + n <= end[doc])
    return C.mix(h[ok]), np.concatenate([[0], np.cumsum(np.bincount(doc[ok], minlength=len(size)))])


@dataclass
class BitmaskFilter:
    langs: list[str]
    masks: np.ndarray  # slots x words
    hashes: int = 3

    @classmethod
    def build(cls, langs: list[str], members: dict[str, np.ndarray], hashes: int = 3) -> BitmaskFilter:
        # a language's slice holds its own n-grams alone, so its fill does not depend on the others
        most, words = max((len(m) for m in members.values()), default=0), -(-len(langs) // 64) or 1
        slots = 1 << max(12, int(np.ceil(np.log2(max(1, most) * 64))))
        while slots * words * 8 > FILTER_BYTES and slots > 8 * most:
            slots //= 2
        f = cls(langs, np.zeros((slots, words), np.uint64), hashes)
        for i, lang in enumerate(langs):
            for s in f.slots(members[lang]):
                f.masks[s, i // 64] |= np.uint64(1 << (i % 64))
        return f

    def slots(self, h: np.ndarray) -> Iterator[np.ndarray]:
        for i in range(self.hashes):
            yield (C.mix(h + np.uint64(i * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) & np.uint64(len(self.masks) - 1)).astype(np.int64)

    def contains(self, h: np.ndarray) -> np.ndarray:
        """Rows of language bits for each n-gram."""
        out = None
        for s in self.slots(h):
            out = self.masks[s] if out is None else out & self.masks[s]
        return out

    def false_positive(self) -> np.ndarray:
        fill = np.asarray([((self.masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(self.langs))])
        return fill**self.hashes

    def counts(self, h: np.ndarray, off: np.ndarray) -> np.ndarray:
        """texts x languages: popcounts corrected for false positives."""
        bits, n, fp = self.contains(h), np.diff(off), self.false_positive()
        out = np.zeros((len(n), len(self.langs)))
        for i in range(len(self.langs)):
            c = np.concatenate([[0], np.cumsum((bits[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1), dtype=np.int64)])
            out[:, i] = np.maximum((c[off[1:]] - c[off[:-1]] - n * fp[i]) / (1 - fp[i]), 0.0)
        return out


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of (n-grams, counts), and the sums of their counts."""
    g, at = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
    n = np.zeros(len(g), np.int64)
    np.add.at(n, at, np.concatenate([n for _, n in parts]))
    return g, n


def train(labelled: DataFrame, top: int = 4000, ratio: float = 0.3) -> BitmaskFilter:
    """labelled: doc_id, text, lang. Reads all of its rows with a label and a text, whole."""
    d = labelled.select("text", "lang").where("lang IS NOT NULL AND text IS NOT NULL")
    langs = sorted(r["lang"] for r in d.select("lang").distinct().collect())
    if not langs:
        return BitmaskFilter.build([], {})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for name, [(g, n)] in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(n, pa.int64())], names=["lang", "gram", "n"])
            held.clear()

        size = 0
        for b in C.pieces(batches):
            names, of = np.unique(np.asarray(C.column(b, "lang").to_pylist(), object), return_inverse=True)
            texts = np.asarray([*C.column(b, "text").to_pylist(), None], object)[:-1]
            for i, name in enumerate(names):
                h, _ = grams(texts[of == i].tolist())
                held.setdefault(name, []).append(np.unique(h, return_counts=True))
                size += len(held[name][-1][0])
            if size > HELD:
                held.update({name: [summed(parts)] for name, parts in held.items()})
                size = sum(len(g) for [(g, _)] in held.values())
                if size > HELD // 2:
                    yield from out()
                    size = 0
        held.update({name: [summed(parts)] for name, parts in held.items()})
        yield from out()

    c = d.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    c = C.written(c, "lang-grams")
    total = c.groupBy("lang").agg(F.sum("n").alias("total"))
    c = c.join(F.broadcast(total), "lang").withColumn("p", F.col("n") / F.col("total"))
    c = c.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("r") <= top)
    c = c.withColumn("best", F.max("p").over(Window.partitionBy("gram"))).where(F.col("p") >= F.col("best") * ratio)
    t = c.select("lang", "gram").toArrow()
    lang, gram = np.asarray(t.column("lang").to_pylist(), object), t.column("gram").to_numpy().view(np.uint64)
    return BitmaskFilter.build(langs, {x: gram[lang == x] for x in langs})


def usual(labelled: DataFrame, model: BitmaskFilter, low: float = 0.01) -> float:
    """The quantile ``low`` of ``known`` in all rows with a label and a letter, down to a step of STEPS."""
    d = labelled.select("text", "lang").where("lang IS NOT NULL AND text IS NOT NULL")
    p = predict(d, model, ("__lang", "__score", "__known")).where(F.col("__lang") != UNDETERMINED)
    steps = sorted(p.groupBy(F.floor(F.col("__known") * STEPS).alias("step")).count().collect())
    if not steps:
        return 0.0
    upto = np.cumsum([n for _, n in steps])
    return steps[int(np.searchsorted(upto, low * upto[-1]))][0] / STEPS


def predict(docs: DataFrame, model: BitmaskFilter, as_: tuple[str, str, str] = ("lang_pred", "score", "known")) -> DataFrame:
    """docs with lang_pred, score and known, or as they are to be called."""
    docs = docs.drop(*as_)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for b in C.pieces(batches):
            texts = C.column(b, "text").to_pylist()
            h, off = grams(texts)
            count = model.counts(h, off) if model.langs else np.zeros((len(texts), 1))
            best, total = count.argmax(1), count.sum(1)
            score = np.divide(count.max(1), total, out=np.zeros(len(texts)), where=total > 0)
            known = np.divide(count.max(1), np.diff(off), out=np.zeros(len(texts)), where=np.diff(off) > 0)
            told = [bool(model.langs and t and LETTER.search(t)) for t in texts]
            pred = [model.langs[i] if k else UNDETERMINED for i, k in zip(best, told, strict=True)]
            yield pa.RecordBatch.from_arrays([*[C.column(b, n) for n in names], pa.array(pred, pa.string()), pa.array(np.where(told, score, 0.0)), pa.array(np.where(told, known, 0.0))], names=[*names, *as_])

    schema = T.StructType([*docs.schema.fields, T.StructField(as_[0], T.StringType()), *[T.StructField(x, T.DoubleType()) for x in as_[1:]]])
    held = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(run, schema)


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def query(spark, sf_dir: str) -> DataFrame:
    d = C.documents(spark, sf_dir)
    model = train(d.where(~held_out()).select("doc_id", "text", "lang"))
    return predict(d.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
