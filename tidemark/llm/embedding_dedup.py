"""Embedding near-dedup: iterative quantisation, multi-index Hamming tables, exact rerank.

A PCA projection and a rotation that balances the bits (ITQ) are fitted on a bounded sample; with fewer
dimensions than bits, random rotations and directions add bits. Every vector gets a binary code, cut into keys, each of
a table: a key has about as many bits as the largest label has rows in binary digits. Near codes differ in
at most one bit of some key, so each code probes its keys and their one-bit neighbours. The number
of tables follows from the recall asked for, as measured on sampled vectors and copies turned by the
threshold's angle inside the projected space, where turning flips the most bits. A pair is taken in
the first table that finds it, if its codes are near as wholes, and is then decided by the cosine
of the original vectors in double precision.

Equal vectors of a label form a class before any of this: a vector that a third of all rows repeat is
one entry with a count. Classes have ids of their own, as vec_ids may repeat. Labels, lengths and table
keys are join keys; nothing is capped.

Edge cases: rows whose label, vec_id or vector is NULL, or whose vector is zero or holds NULL or a
non-finite number, link with nothing; vectors link only with those of their own length; very small and
very large components are scaled by a power of two; repeated rows are rows like others; a NULL vec_id
has no component and is kept; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common as C

#: Dimensions that a rotation has at most; bits of a key; bytes of the sample on the driver.
DIMS, LEAST_KEY, MOST_KEY, SAMPLE_BYTES = 64, 8, 32, 64 << 20
#: Of the pairs that no table has found yet, the part that another must find for its planes to go on.
LEAST_GAIN = 0.3


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two, so that squares neither vanish nor overflow; cosines stay as they are."""
    most = np.abs(x).max(1, initial=0.0)
    return np.ldexp(x, -np.frexp(most)[1][:, None])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class ITQ:
    """Codes of any number of bits: on which side of a plane a vector is. The first planes go through the mean
    along a rotation that is found by alternating between signs and the rotation that fits them best; the
    same search would find the same planes again, so the next ones are of random rotations. Where these
    no longer find new pairs, as with few dimensions or a mean that nearly all vectors are at, planes go through the
    origin in random directions, of which turning by a small angle crosses few, whatever the data."""

    def __init__(self, x: np.ndarray, rounds: int = 30, seed: int = 5) -> None:
        """x: sampled vectors, a row each."""
        self.x = unit(x)
        self.mean, self.rounds, self.seed, self.centred = self.x.mean(0), rounds, seed, True
        _, vec = np.linalg.eigh((self.x - self.mean).T @ (self.x - self.mean))
        self.basis = vec[:, ::-1][:, :DIMS]
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def _part(self) -> tuple[np.ndarray, np.ndarray]:
        rng, d = np.random.default_rng(self.seed + len(self.parts)), self.basis.shape[1]
        if not self.centred:
            return rng.normal(size=(len(self.mean), DIMS)), np.zeros(DIMS)
        r = np.linalg.qr(rng.normal(size=(d, d)))[0]
        if not self.parts:
            v = (self.x - self.mean) @ self.basis
            for _ in range(self.rounds):
                u, _, t = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
                r = (u @ t).T
        p = self.basis @ r
        return p, self.mean @ p

    def planes(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Directions, a column each, and how far from the origin."""
        while sum(len(o) for _, o in self.parts) < bits:
            self.parts.append(self._part())
        return np.concatenate([p for p, _ in self.parts], 1)[:, :bits], np.concatenate([o for _, o in self.parts])[:bits]

    def tables(self, key: int, threshold: float, recall: float, trials: int = 512) -> int:
        """Tables of keys of so many bits that reach the recall."""
        rng = np.random.default_rng(self.seed)
        x = self.x[rng.integers(len(self.x), size=trials)]
        u = rng.normal(size=(trials, self.basis.shape[1])) @ self.basis.T
        u -= (u * x).sum(1, keepdims=True) * x
        length = np.linalg.norm(u, axis=1, keepdims=True)
        u = np.divide(u, length, out=np.zeros_like(u), where=length > 1e-9)
        y = threshold * x + np.sqrt(1 - threshold**2) * u
        met, n = np.zeros(trials, bool), 0
        while n == 0 or met.mean() < recall:
            n += 1
            p, o = self.planes(n * key)
            now = ((x @ p[:, -key:] >= o[-key:]) != (y @ p[:, -key:] >= o[-key:])).sum(1) <= 1
            self.centred &= bool(now[~met].mean() >= LEAST_GAIN)
            met |= now
        return n


def _matrix(c: pa.Array, width: int) -> np.ndarray:
    """Rows of a list array, padded with zeros."""
    n = pc.list_value_length(c).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = c.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(n), width))
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def near_vectors(vectors: DataFrame, threshold: float = 0.98, sample: int = 20_000, recall: float = 0.99) -> DataFrame:
    """vec_id, n_links, component_id, kept. sample: rows that the codes are fitted on, fewer where they
    are long; recall: of pairs at the threshold."""
    v = vectors.select("vec_id", "label", "embedding")
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = v.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").where(F.coalesce(~bad, F.lit(False)) & F.exists("embedding", lambda x: x != 0))
    key = ["label", "h1", "h2"]
    good = good.withColumns({"h1": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit(1), "embedding")})
    classes = good.groupBy(*key).agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("m"), F.min("embedding").alias("embedding"))
    reps = C.written(classes.select(F.monotonically_increasing_id().alias("id"), *key, "least", "m", F.size("embedding").alias("dim"), "embedding"), "vector-classes")
    classes = reps.select("id", *key, "least", "m")

    types = dict(reps.dtypes)
    most = reps.agg(F.max("dim")).first()[0] or 1
    n_label = reps.groupBy("label").count().agg(F.max("count")).first()[0] or 1
    bits = int(np.clip(np.ceil(np.log2(n_label)), LEAST_KEY, MOST_KEY))
    rows = max(1, min(sample, SAMPLE_BYTES // (8 * most)))
    some = reps.orderBy(F.xxhash64("id"), "id").limit(rows).select("embedding").toArrow().column("embedding").combine_chunks()
    itq = ITQ(_matrix(some, most) if len(some) else np.ones((1, most)))
    tables = itq.tables(bits, threshold, recall)
    planes, offsets = itq.planes(tables * bits)
    # flips of the whole code, beyond which a pair at the threshold is out by six deviations
    flip = np.arccos(threshold) / np.pi
    radius = int(np.ceil(2 * tables * bits * flip + 6 * np.sqrt(tables * bits * flip)))
    names = [f"k{t}" for t in range(tables)]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = np.uint64(1) << np.arange(bits, dtype=np.uint64)
        for b in batches:
            sign = unit(_matrix(C.column(b, "embedding"), most)) @ planes >= offsets
            code = [(sign[:, t * bits : (t + 1) * bits] * weight).sum(1, dtype=np.uint64).view(np.int64) for t in range(tables)]
            yield pa.RecordBatch.from_arrays([*[C.column(b, n) for n in ("id", "label", "dim")], *map(pa.array, code)], names=["id", "label", "dim", *names])

    codes = C.written(reps.select("id", "label", "dim", "embedding").mapInArrow(encode, f"id long, label {types['label']}, dim int, {', '.join(f'{n} long' for n in names)}"), "vector-codes")
    keys = F.array(*[F.struct(F.lit(t).alias("t"), F.col(n).alias("s")) for t, n in enumerate(names)])
    own = lambda x: [F.col("id").alias(x), *[F.col(n).alias(f"{x}{n}") for n in names]]
    index = codes.select("label", "dim", *own("b"), F.inline(keys))
    flips = F.array(*[F.lit(f).cast("long") for f in (0, *[1 << i for i in range(bits)])])
    probe = codes.select("label", "dim", *own("a"), F.inline(keys)).select("label", "dim", *[f"a{n}" for n in names], "a", "t", F.explode(F.transform(flips, lambda f: F.col("s").bitwiseXOR(f))).alias("s"))
    differ = [F.bit_count(F.col(f"a{n}").bitwiseXOR(F.col(f"b{n}"))) for n in names]
    earlier = reduce(Column.__or__, [(F.col("t") > t) & (d <= 1) for t, d in enumerate(differ[:-1])], F.lit(False))
    pairs = probe.join(index, ["label", "dim", "t", "s"]).where((F.col("a") < F.col("b")) & (reduce(Column.__add__, differ) <= radius) & ~earlier).select("a", "b")

    vec = reps.select("id", "m", "embedding")
    left = pairs.join(vec.select(F.col("id").alias("a"), F.col("m").alias("ma"), F.col("embedding").alias("ea")), "a")
    both = left.join(vec.select(F.col("id").alias("b"), F.col("m").alias("mb"), F.col("embedding").alias("eb")), "b").select("a", "b", "ma", "mb", "ea", "eb")

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = scaled(_matrix(C.column(b, "ea"), most)), scaled(_matrix(C.column(b, "eb"), most))
            cos = np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))
            yield pa.RecordBatch.from_arrays([C.column(b, n) for n in ("a", "b", "ma", "mb")], names=["a", "b", "ma", "mb"]).filter(pa.array(cos >= threshold))

    links = C.written(both.mapInArrow(rerank, "a long, b long, ma long, mb long"), "vector-links")
    comp = C.components(links, "vector")
    n = links.select(F.col("a").alias("id"), F.col("mb").alias("m")).unionByName(links.select(F.col("b").alias("id"), F.col("ma").alias("m"))).groupBy("id").agg(F.sum("m").alias("others"))
    label = comp.join(classes.select("id", "least"), "id")
    first = label.groupBy("component_id").agg(F.min("least").alias("first"))
    found = classes.join(n, "id", "left").join(comp.join(first, "component_id").select("id", "first"), "id", "left")
    found = found.select(*key, (F.col("m") - 1 + F.coalesce("others", F.lit(0))).alias("n"), F.coalesce("first", "least").alias("c"))
    member = v.withColumns({"h1": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit(1), "embedding")}).where("vec_id IS NOT NULL AND label IS NOT NULL").join(found, key, "left")
    rest = v.where("vec_id IS NULL OR label IS NULL").select("vec_id", F.lit(None).cast("long").alias("n"), F.lit(None).cast(dict(v.dtypes)["vec_id"]).alias("c"))
    d = member.select("vec_id", "n", "c").unionByName(rest)
    c = F.coalesce("c", "vec_id")
    return d.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), c.alias("component_id"), F.coalesce(c == F.col("vec_id"), F.lit(True)).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_vectors(C.table(spark, sf_dir, "embeddings"))
