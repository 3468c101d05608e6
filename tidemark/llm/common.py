"""What the corpus operators share: scratch tables, Arrow texts as byte arrays, rolling hashes,
packed exchanges, and connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words: space and 0x09-0x0D.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Text handled at once by the numpy stages; a longer document is a piece of its own.
PIECE_BYTES = 1 << 20
U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver's. The program may run in another folder, so workers are told this package's;
    on a cluster the package is shipped with --py-files."""
    for_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def for_workers(spark: SparkSession) -> None:
    """Python workers find this package, and give memory back: without Arrow's own pool, and with few arenas."""
    env = spark.sparkContext.environment
    for k, v in {"PYTHONPATH": str(Path(__file__).resolve().parents[2]), "ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "2"}.items():
        env.setdefault(k, v)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a session on one machine gets a temporary
    one; on a cluster it has to be set, as executors see no folder of another machine."""
    d = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_tidemark_dir", None)
    if not d:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = spark._tidemark_dir = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    return d.rstrip("/")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, and its lineage is cut."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(df: DataFrame, bytes_each: int = 32 << 20) -> int:
    """Shuffle partitions: the session's, or more where the plan's size estimate asks for it."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(size // bytes_each, 1_000_000))


# ------------------------------------------------------------------ texts


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices with about ``limit`` bytes of text, at least a row each."""
    for b in batches:
        if not b.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(b.column(b.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 32
        cut = np.cumsum(size) // limit
        edges = np.flatnonzero(np.diff(cut, prepend=cut[0] - 1))
        for i, j in zip(edges, [*edges[1:], b.num_rows], strict=True):
            yield b.slice(int(i), int(j - i))


def column(b: pa.RecordBatch, name: str) -> pa.Array:
    return b.column(b.schema.get_field_index(name))


def longs(b: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Values and which of them are given."""
    c = column(b, name)
    return pc.fill_null(c, 0).to_numpy(zero_copy_only=False).astype(np.int64), pc.is_valid(c).to_numpy(zero_copy_only=False)


def text_bytes(b: pa.RecordBatch, name: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """All texts as one array of UTF-8 bytes, and the n + 1 offsets; NULL is empty."""
    a = pc.fill_null(column(b, name).cast(pa.large_string()), "")
    bufs = a.buffers()
    off = np.frombuffer(bufs[1], np.int64, count=len(a) + 1 + a.offset)[a.offset :]
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def word_spans(buf: np.ndarray, off: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in buf, and the n + 1 offsets of documents into them."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    word = ~space[buf]
    before, after = np.empty(len(buf), bool), np.empty(len(buf), bool)
    before[0], before[1:] = True, ~word[:-1]
    after[-1], after[:-1] = True, ~word[1:]
    first = off[:-1]
    before[first[first < len(buf)]] = True
    last = off[1:] - 1
    after[last[last >= 0]] = True
    starts, ends = np.flatnonzero(word & before), np.flatnonzero(word & after) + 1
    return starts, ends, np.searchsorted(starts, off)


# ------------------------------------------------------------------ rolling hashes

#: A prime; a polynomial of degree d has at most d zeros modulo it, whatever the text's structure.
P61 = (1 << 61) - 1
_LOW31, _LOW30 = U64((1 << 31) - 1), U64((1 << 30) - 1)


def _fold(x: np.ndarray) -> np.ndarray:
    """x < 2**64 modulo P61."""
    x = (x & U64(P61)) + (x >> U64(61))
    return np.where(x >= U64(P61), x - U64(P61), x)


def _join(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """high * 2**31 + low modulo P61, of high below 2**63 and low below 2**62."""
    return _fold((high >> U64(30)) + ((high & _LOW30) << U64(31)) + low)


def mulmod(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo P61, of factors below P61."""
    ah, al, bh, bl = a >> U64(31), a & _LOW31, b >> U64(31), b & _LOW31
    middle = ah * bl + al * bh
    return _fold((ah * bh << U64(1)) + (middle >> U64(30)) + ((middle & _LOW30) << U64(31)) + al * bl)


class PrimeRoll:
    """Rabin-Karp hash, modulo a prime, of any slice of a sequence of symbols, from prefix sums."""

    _tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, symbols: np.ndarray, base: int) -> None:
        """symbols: bytes, or hashes of which the low 61 bits are taken."""
        n, base = len(symbols), base % P61
        if base not in self._tables or len(self._tables[base][0]) <= n:
            self._tables[base] = tuple(self._powers(x, max(1 << 18, n + 1)) for x in (base, pow(base, -1, P61)))
        pw, self.inverse = self._tables[base]
        if symbols.dtype == np.uint8 and n < 1 << 24:  # products and their sums fit, unreduced
            c = symbols.astype(U64) + U64(1)
            high, low = c * (pw[:n] >> U64(31)), c * (pw[:n] & _LOW31)
        else:
            c = symbols.astype(U64) + U64(1) if symbols.dtype == np.uint8 else _fold(symbols & U64(P61))
            term = mulmod(c, pw[:n])
            high, low = term >> U64(31), term & _LOW31
        self.high, self.low = np.zeros(n + 1, U64), np.zeros(n + 1, U64)
        np.cumsum(high, out=self.high[1:])
        np.cumsum(low, out=self.low[1:])

    @staticmethod
    def _powers(base: int, size: int) -> np.ndarray:
        out = np.ones(1, U64)
        while len(out) < size:
            out = np.concatenate([out, mulmod(out, U64(pow(base, len(out), P61)))])
        return out

    def slices(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mix(mulmod(_join(self.high[hi] - self.high[lo], self.low[hi] - self.low[lo]), self.inverse[lo]))


class Roll:
    """Polynomial hash modulo 2**64 of any slice of a sequence of 64-bit symbols, from prefix sums. Long
    slices of a regular structure may collide: only for short ones, or where what it finds is compared."""

    _tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, symbols: np.ndarray, base: int) -> None:
        n = len(symbols)
        if base not in self._tables or len(self._tables[base][0]) <= n:
            size = max(1 << 20, n + 1)
            inv = pow(base, -1, 1 << 64)
            self._tables[base] = tuple(np.concatenate([np.ones(1, U64), np.multiply.accumulate(np.full(size, x, U64))]) for x in (base, inv))
        self.pw, self.inv = self._tables[base]
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(symbols * self.pw[:n], out=self.sums[1:])

    def slices(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mix((self.sums[hi] - self.sums[lo]) * self.inv[lo])


#: Odd multipliers: two independent hashes of one slice make 122 bits.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)


def byte_symbols(buf: np.ndarray) -> np.ndarray:
    return _BYTE[buf]


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BASES[0]) -> np.ndarray:
    return PrimeRoll(buf, base).slices(starts, ends)


def sliding_argmin(g: np.ndarray, width: int) -> np.ndarray:
    """For each i up to len(g) - width: the leftmost place of the minimum of g[i : i + width]."""
    n = len(g) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at, have = np.arange(len(g)), 1
    while have < width:
        step = min(have, width - have)
        a, b = at[: len(at) - step], at[step:]
        at, have = np.where(g[a] <= g[b], a, b), have + step
    return at[:n]


# ------------------------------------------------------------------ packed exchanges


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as byte planes, which the shuffle's compression likes."""
    return b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays)


def unpack(blob: bytes, dtypes: list) -> list[np.ndarray]:
    dtypes = [np.dtype(d) for d in dtypes]
    n = len(blob) // sum(d.itemsize for d in dtypes)
    raw, out, at = np.frombuffer(blob, np.uint8), [], 0
    for d in dtypes:
        out.append(np.ascontiguousarray(raw[at : at + n * d.itemsize].reshape(d.itemsize, n).T).view(d).reshape(n))
        at += n * d.itemsize
    return out


def by_bucket(bucket: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    edges = np.flatnonzero(np.diff(b, prepend=-1))
    sorted_ = [a[order] for a in arrays]
    for i, j in zip(edges, np.append(edges, len(b))[1:], strict=True):
        yield int(b[i]), [a[i:j] for a in sorted_]


PACKED = "bucket int, kind int, blob binary"


def packed_batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["bucket", "kind", "blob"]
    )


def unpacked(table: pa.Table, kind: int, dtypes: list) -> list[np.ndarray]:
    """The arrays of all blobs of a kind, joined."""
    blobs = [b for k, b in zip(table.column("kind").to_pylist(), table.column("blob").to_pylist(), strict=True) if k == kind]
    parts = [unpack(b, dtypes) for b in blobs]
    return [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, d) for i, d in enumerate(dtypes)]


def groups_of(sorted_keys: list[np.ndarray]) -> np.ndarray:
    """True where a row's keys differ from those of the row before."""
    n = len(sorted_keys[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = False
        for k in sorted_keys:
            new[1:] |= k[1:] != k[:-1]
    return new


# ------------------------------------------------------------------ connected components


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(id, component_id) of every id in ``edges`` (a, b): the smallest id reachable.

    Labels take the least label among neighbours, then the label of that label, so that paths shorten
    by half or more in each round. Each round is a written table; only a count goes to the driver."""
    both = written(edges.select("a", "b").where("a <> b").unionByName(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("a")).alias("component_id")), f"{name}-labels")
    while True:
        l = labels  # noqa: E741
        near = both.join(l.select(F.col("id").alias("b"), "component_id"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component_id").alias("m"))
        low = l.join(near, "id").select("id", F.least("component_id", "m").alias("m"), F.col("component_id").alias("old"))
        jump = low.join(l.select(F.col("id").alias("m"), F.col("component_id").alias("far")), "m", "left")
        nxt = written(jump.select("id", F.least("m", F.coalesce("far", "m")).alias("component_id"), (F.least("m", F.coalesce("far", "m")) < F.col("old")).alias("moved")), f"{name}-labels")
        labels = nxt.drop("moved")
        if nxt.where("moved").isEmpty():
            return labels
