"""Substring dedup: Rabin-Karp hashes of fixed-length word windows, counted in Spark.

1. A hash of half a window is rolled over each text; the least of those inside a window is its
   anchor. Equal windows have equal anchors, so a window whose anchor occurs once in the corpus
   occurs once: it is counted without being moved. One exchange of anchors (about a sixth of the
   words) counts them.
2. Every other window gets two Rabin-Karp hashes modulo a prime, 122 bits. An exchange by anchor finds for each hash the
   first place, by (doc_id, start); all later places are repeats, as runs of starts.
3. Runs are merged into maximal intervals of words, which are taken out.

Rows move packed, by hash bucket. Within a piece of input, repeats of a hash are settled before the
exchange, so a passage that a third of all documents hold adds one entry per piece. Texts are
exchanged once, by doc_id; the plan uses that exchange twice.

Edge cases: NULL or empty texts have no words; a row without doc_id keeps its text and is nobody's
original; rows that repeat a doc_id count as one document, whose windows do not repeat themselves
across such rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common as C

MAIN, FOLLOWER = 0, 1
#: hash, doc, first and last window start of an anchor
ANCHOR = [np.uint64, np.int64, np.uint32, np.uint32]
RANGE = [np.int64, np.uint32, np.uint32, np.uint64]
WINDOW = [np.uint64, np.uint64, np.int64, np.uint32]


def anchor_runs(hashes: np.ndarray, seq_off: np.ndarray, doc_of: np.ndarray, window: int, part: int) -> tuple[np.ndarray, ...]:
    """Anchors of all windows of ``window`` symbols in sequences with offsets seq_off, given the hash
    of the ``part`` symbols from each place on: sequence, hash, first and last start that it serves."""
    reach = window - part + 1
    at = C.sliding_argmin(hashes, reach)
    n = len(at)
    if not n:
        z = np.zeros(0, np.int64)
        return z, np.zeros(0, np.uint64), z, z
    valid = np.arange(n) + window <= seq_off[1:][doc_of[:n]]
    p = np.flatnonzero(valid)
    a = at[p]
    new = np.ones(len(p), bool)
    new[1:] = (a[1:] != a[:-1]) | (p[1:] != p[:-1] + 1) | (doc_of[p[1:]] != doc_of[p[:-1]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(p)) - 1
    seq = doc_of[p[first]]
    return seq, hashes[a[first]], p[first] - seq_off[seq], p[last] - seq_off[seq]


def rows_of_anchors(doc: np.ndarray, h: np.ndarray, lo: np.ndarray, hi: np.ndarray, buckets: int) -> Iterator[tuple[int, int, bytes]]:
    """Of a hash that occurs again in the piece, one entry moves with a count of at least two."""
    order = np.argsort(h, kind="stable")
    new = C.groups_of([h[order]])
    again = np.zeros(len(h), bool)
    again[order] = ~new
    multi = np.zeros(len(h), bool)
    if len(h):
        multi[order] = np.add.reduceat(np.ones(len(h), np.int64), np.flatnonzero(new))[np.cumsum(new) - 1] > 1
    f = again | multi
    for b, x in C.by_bucket((doc[f] % buckets).astype(np.int64), doc[f], lo[f].astype(np.uint32), hi[f].astype(np.uint32), h[f]):
        yield b, FOLLOWER, C.pack(*x)
    # hi below lo marks an entry that is known to repeat and already reported
    m = ~again
    lo, hi = np.where(multi, 1, lo), np.where(multi, 0, hi)
    for b, x in C.by_bucket((h[m] % np.uint64(buckets)).astype(np.int64), h[m], doc[m], lo[m].astype(np.uint32), hi[m].astype(np.uint32)):
        yield b, MAIN, C.pack(*x)


def repeated_anchors(table: pa.Table) -> pa.Table:
    """The anchors of a bucket that occur more than once: doc_id, lo, hi, anchor."""
    h, doc, lo, hi = C.unpacked(table, MAIN, ANCHOR)
    fd, flo, fhi, fh = C.unpacked(table, FOLLOWER, RANGE)
    order = np.argsort(h, kind="stable")
    h, doc, lo, hi = h[order], doc[order], lo[order], hi[order]
    same = ~C.groups_of([h])
    keep = same.copy()
    keep[:-1] |= same[1:]
    keep &= hi >= lo
    return range_table(np.concatenate([doc[keep], fd]), np.concatenate([lo[keep], flo]), np.concatenate([hi[keep], fhi]), np.concatenate([h[keep], fh]))


RANGES = "doc_id long, lo int, hi int, anchor long"


def range_table(doc, lo, hi, anchor) -> pa.Table:
    return pa.table({"doc_id": pa.array(doc, pa.int64()), "lo": pa.array(lo.astype(np.int32)), "hi": pa.array(hi.astype(np.int32)), "anchor": pa.array(np.ascontiguousarray(anchor, dtype=np.uint64).view(np.int64))})


def merged_runs(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of starts, joined where they touch or overlap."""
    if not len(doc):
        return doc, lo, hi
    order = np.lexsort((lo, doc))
    doc, lo, hi = doc[order], lo[order].astype(np.int64), hi[order].astype(np.int64)
    # running maximum of hi within a document, by an offset that grows from document to document
    rank = np.cumsum(np.diff(doc, prepend=doc[0]) != 0)
    span = int(hi.max()) + 2
    top = np.maximum.accumulate(hi + rank * span) - rank * span
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (lo[1:] > top[:-1] + 1)
    first = np.flatnonzero(new)
    return doc[first], lo[first], top[np.append(first[1:], len(doc)) - 1]


def with_ranges(docs: DataFrame, ranges: DataFrame) -> DataFrame:
    """docs with the array of their ranges; the exchange of texts is the same for every call."""
    per = ranges.groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi", "anchor")).alias("ranges"))
    return docs.join(per.hint("shuffle_hash"), "doc_id", "left")


def range_lists(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, lo, hi and anchor of all ranges of a batch."""
    c = C.column(b, "ranges")
    n = np.asarray([0 if x is None else x for x in pc.list_value_length(c).to_pylist()], np.int64)
    flat = c.flatten()
    get = lambda f: flat.field(f).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(n)), n), get("lo").astype(np.int64), get("hi").astype(np.int64), get("anchor").astype(np.int64).view(np.uint64)


def expand(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All integers of the ranges [lo, hi], and of which range each is."""
    n = hi - lo + 1
    of = np.repeat(np.arange(len(lo)), n)
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n), of


def _words(b: pa.RecordBatch):
    buf, off = C.text_bytes(b)
    starts, ends, woff = C.word_spans(buf, off)
    return buf, starts, ends, woff, np.repeat(np.arange(len(woff) - 1), np.diff(woff))


def dedup_substrings(docs: DataFrame, window: int = 20) -> DataFrame:
    """doc_id, text (the kept words, one space between), n_words, n_removed, and spans: the removed
    intervals of word places [lo, hi)."""
    part = window // 2
    n_buckets = 4 * C.partitions(docs)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.pieces(batches):
            buf, starts, ends, woff, doc_of = _words(b)
            ids, given = C.longs(b, "doc_id")
            n = len(starts)
            if n < window:
                continue
            roll = C.Roll(C.word_hashes(buf, starts, ends), C.BASES[0])
            i = np.arange(n - part + 1)
            seq, h, lo, hi = anchor_runs(roll.slices(i, i + part), woff, doc_of, window, part)
            ok = given[seq]
            if rows := list(rows_of_anchors(ids[seq[ok]], h[ok], lo[ok], hi[ok], n_buckets)):
                yield C.packed_batch(rows)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.pieces(batches):
            buf, starts, ends, woff, _ = _words(b)
            ids, _ = C.longs(b, "doc_id")
            row, lo, hi, anchor = range_lists(b)
            p, of = expand(lo, hi)
            if not len(p):
                continue
            at = p + woff[row[of]]
            h1, h2 = (C.PrimeRoll(C.word_hashes(buf, starts, ends, x), x).slices(at, at + window) for x in C.BASES)
            doc, bucket = ids[row[of]], (anchor[of] % np.uint64(n_buckets)).astype(np.int64)
            order = np.lexsort((p, doc, h2, h1))
            h1, h2, doc, p, bucket, anchor = h1[order], h2[order], doc[order], p[order], bucket[order], anchor[of][order]
            new = C.groups_of([h1, h2])
            later = ~new & differs_from_first(new, doc, p)
            rows = [(k, MAIN, C.pack(*x)) for k, x in C.by_bucket(bucket[new], h1[new], h2[new], doc[new], p[new].astype(np.uint32))]
            fd, flo, fhi = merged_runs(doc[later], p[later], p[later])
            rows += [(k, FOLLOWER, C.pack(*x)) for k, x in C.by_bucket(fd % n_buckets, fd, flo.astype(np.uint32), fhi.astype(np.uint32), np.zeros(len(fd), np.uint64))]
            yield C.packed_batch(rows)

    def repeats(table: pa.Table) -> pa.Table:
        h1, h2, doc, p = C.unpacked(table, MAIN, WINDOW)
        fd, flo, fhi, _ = C.unpacked(table, FOLLOWER, RANGE)
        order = np.lexsort((p, doc, h2, h1))
        h1, h2, doc, p = h1[order], h2[order], doc[order], p[order]
        new = C.groups_of([h1, h2])
        later = ~new & differs_from_first(new, doc, p)
        d, lo, hi = merged_runs(np.concatenate([doc[later], fd]), np.concatenate([p[later], flo]), np.concatenate([p[later], fhi]))
        return range_table(d, lo, hi, np.zeros(len(d), np.uint64))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.pieces(batches):
            row, lo, hi, _ = range_lists(b)
            row, lo, hi = merged_runs(row, lo, hi + window - 1)
            cut: dict[int, list[tuple[int, int]]] = {}
            for r, i, j in zip(row.tolist(), lo.tolist(), hi.tolist(), strict=True):
                cut.setdefault(r, []).append((i, j + 1))
            kept, n_words, n_removed, spans = [], [], [], []
            for r, t in enumerate(C.column(b, "text").to_pylist()):
                w = t.encode().split() if t else []
                gone = cut.get(r, [])
                n_words.append(len(w))
                n_removed.append(sum(j - i for i, j in gone))
                for i, j in reversed(gone):
                    del w[i:j]
                kept.append(b" ".join(w).decode())
                spans.append([{"lo": i, "hi": j} for i, j in gone])
            yield pa.RecordBatch.from_arrays(
                [C.column(b, "doc_id"), pa.array(kept, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())])))],
                names=["doc_id", "text", "n_words", "n_removed", "spans"],
            )

    found = docs.mapInArrow(anchors, C.PACKED).groupBy("bucket").applyInArrow(repeated_anchors, RANGES)
    moved = with_ranges(docs, found).mapInArrow(windows, C.PACKED)
    later = moved.groupBy("bucket").applyInArrow(repeats, RANGES)
    return with_ranges(docs, later).mapInArrow(remove, "doc_id long, text string, n_words long, n_removed long, spans array<struct<lo:int,hi:int>>")


def differs_from_first(new: np.ndarray, doc: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Is the place another than the first of its group?"""
    if not len(new):
        return new
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    return (doc != doc[first]) | (p != p[first])


def query(spark, sf_dir: str) -> DataFrame:
    d = dedup_substrings(C.documents(spark, sf_dir))
    return d.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
