"""Suffix-array dedup: repeated byte strings by deep-shallow sorted, sampled suffixes.

A suffix array of every byte would move a hundred times the corpus. Instead suffixes are sampled by
content: the anchor of a 100-byte string is the place of the least hash among its 40-byte parts, so
equal strings have their anchors at one offset and are found from the suffixes at anchors alone.

1. Anchors are counted by hash (one exchange, packed); a string whose anchor occurs once occurs once.
2. For each anchor that repeats, the bytes around it move, once per distinct context and piece.
   In a bucket, the texts to the right of the anchors of one hash are sorted by multikey quicksort to
   a shallow depth and by blind tries below it, and so are the reversed texts to their left. The
   common prefixes of neighbours give each anchor's classes of equal right and left texts of every
   length; a 100-byte string is the pair (left class, right class) at its offset, exactly: the hash
   only brings suffixes together, bytes decide. The first by (doc_id, start) of a pair stays, the
   others are repeats.
3. Runs of repeated starts are merged and their bytes taken out.

Edge cases: NULL is empty; texts under 100 bytes lose nothing; a row without doc_id keeps its text and
is nobody's original; rows that repeat a doc_id count as one document; other columns are ignored. A
removed run may begin or end inside a character, so kept bytes are binary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common as C
from tidemark.llm import substring_dedup as W
from tidemark.llm.deep_shallow import deep_shallow_sort

#: anchor hash, doc, start, length and anchor place of a context; the bytes follow in a blob of their own
CONTEXT = [np.uint64, np.int64, np.uint32, np.uint8, np.uint8]


def _pack_contexts(sel: np.ndarray, meta: list[np.ndarray], texts: list[bytes]) -> bytes:
    head = C.pack(*[m[sel] for m in meta])
    return len(sel).to_bytes(8, "big") + head + b"".join(texts[i] for i in sel)


def _unpack_contexts(table: pa.Table) -> tuple[list[np.ndarray], list[bytes]]:
    parts, texts = [], []
    size = sum(np.dtype(d).itemsize for d in CONTEXT)
    for kind, blob in zip(table.column("kind").to_pylist(), table.column("blob").to_pylist(), strict=True):
        if kind != W.MAIN:
            continue
        n = int.from_bytes(blob[:8], "big")
        meta = C.unpack(blob[8 : 8 + n * size], CONTEXT)
        parts.append(meta)
        at = 8 + n * size
        for length in meta[3].tolist():
            texts.append(blob[at : at + length])
            at += length
    return [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, d) for i, d in enumerate(CONTEXT)], texts


def _classes(lcps: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Class of each string by its first ``length`` bytes, from the sorted order and common prefixes."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(lcps < length)
    return out


def repeated_starts(h: np.ndarray, doc: np.ndarray, lo: np.ndarray, place: np.ndarray, texts: list[bytes], window: int, part: int, shallow: int) -> tuple[np.ndarray, np.ndarray]:
    """(doc, start) of the windows, of all the contexts' windows, that equal one earlier."""
    by = sorted(range(len(texts)), key=lambda i: (int(h[i]), texts[i], int(doc[i]), int(lo[i])))
    out_doc, out_start = [], []
    reps: list[int] = []
    i = 0
    while i < len(by):  # of equal contexts, all but the first repeat whole
        j = i + 1
        first = by[i]
        while j < len(by) and h[by[j]] == h[first] and texts[by[j]] == texts[first]:
            k = by[j]
            if (doc[k], lo[k]) != (doc[first], lo[first]):
                n = len(texts[k]) - window + 1
                out_doc.append(np.full(n, doc[k]))
                out_start.append(np.arange(n) + int(lo[k]))
            j += 1
        reps.append(first)
        i = j
    reps_a = np.asarray(reps, np.int64)
    right_order, right_lcp, left_order, left_lcp, used = [], [], [], [], []
    edges = np.flatnonzero(C.groups_of([h[reps_a]]))
    for i, j in zip(edges, np.append(edges, len(reps_a))[1:], strict=True):
        if j - i < 2:
            continue
        group = reps_a[i:j].tolist()
        base = len(used)
        used.extend(group)
        right = [texts[k][int(place[k]) :] for k in group]
        left = [texts[k][: int(place[k])][::-1] for k in group]
        # the parts that were hashed are equal, unless hashes collide
        same = part if all(r[:part] == right[0][:part] for r in right) else 0
        for strings, start, orders, lcps in ((right, same, right_order, right_lcp), (left, 0, left_order, left_lcp)):
            o, l = deep_shallow_sort(strings, start, shallow)  # noqa: E741
            orders.extend(base + x for x in o)
            lcps.extend(l)
    if used:
        u = np.asarray(used, np.int64)
        ud, ul, up, n = doc[u], lo[u].astype(np.int64), place[u].astype(np.int64), np.asarray([len(texts[k]) for k in used])
        ro, rl, lo_, ll = (np.asarray(x, np.int64) for x in (right_order, right_lcp, left_order, left_lcp))
        for o in range(window - part + 1):  # the window begins o bytes before the anchor
            sel = np.flatnonzero((o <= up) & (up - o + window <= n))
            if len(sel) < 2:
                continue
            r, l = _classes(rl, ro, window - o)[sel], _classes(ll, lo_, o)[sel]  # noqa: E741
            start = ul[sel] + up[sel] - o
            order = np.lexsort((start, ud[sel], l, r))
            new = C.groups_of([r[order], l[order]])
            later = ~new & W.differs_from_first(new, ud[sel][order], start[order])
            out_doc.append(ud[sel][order][later])
            out_start.append(start[order][later])
    z = [np.zeros(0, np.int64)]
    return np.concatenate(out_doc or z), np.concatenate(out_start or z)


def dedup_suffixes(docs: DataFrame, window: int = 100, part: int = 40, shallow: int = 16) -> DataFrame:
    """doc_id, kept (binary), n_bytes, n_removed, and spans: the maximal removed byte intervals [lo, hi)."""
    if not 0 < part <= window or 2 * window - part > 255:
        raise ValueError("part must be at most window, and a context at most 255 bytes")
    n_buckets = 4 * C.partitions(docs)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.pieces(batches):
            buf, off = C.text_bytes(b)
            ids, given = C.longs(b, "doc_id")
            if len(buf) < window:
                continue
            i = np.arange(len(buf) - part + 1)
            seq, h, lo, hi = W.anchor_runs(C.Roll(C.byte_symbols(buf), C.BASES[0]).slices(i, i + part), off, np.repeat(np.arange(len(ids)), np.diff(off)), window, part)
            ok = given[seq]
            if rows := list(W.rows_of_anchors(ids[seq[ok]], h[ok], lo[ok], hi[ok], n_buckets)):
                yield C.packed_batch(rows)

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.pieces(batches):
            row, lo, hi, h = W.range_lists(b)
            if not len(row):
                continue
            buf, off = C.text_bytes(b)
            raw, ids = buf.tobytes(), C.longs(b, "doc_id")[0]
            order = np.lexsort((lo, ids[row]))
            row, lo, hi, h = row[order], lo[order], hi[order], h[order]
            at = off[row]
            texts = [raw[i:j] for i, j in zip((at + lo).tolist(), (at + hi + window).tolist(), strict=True)]
            first: dict[tuple[int, bytes], int] = {}
            keep = np.fromiter((first.setdefault((g, t), k) == k for k, (g, t) in enumerate(zip(h.tolist(), texts, strict=True))), bool, len(texts))
            doc = ids[row]
            origin = np.fromiter((first[g, t] for g, t in zip(h.tolist(), texts, strict=True)), np.int64, len(texts))
            later = ~keep & ((doc != doc[origin]) | (lo != lo[origin]))
            place = _anchor_places(buf, at + lo, hi - lo, window, part, h)
            meta = [h, doc, lo.astype(np.uint32), np.asarray([len(t) for t in texts], np.uint8), place.astype(np.uint8)]
            main = np.flatnonzero(keep)
            rows = [(k, W.MAIN, _pack_contexts(x[0], meta, texts)) for k, x in C.by_bucket((h[main] % np.uint64(n_buckets)).astype(np.int64), main)]
            fd, flo, fhi = W.merged_runs(doc[later], lo[later], hi[later])
            rows += [(k, W.FOLLOWER, C.pack(*x)) for k, x in C.by_bucket(fd % n_buckets, fd, flo.astype(np.uint32), fhi.astype(np.uint32), np.zeros(len(fd), np.uint64))]
            yield C.packed_batch(rows)

    def repeats(table: pa.Table) -> pa.Table:
        (h, doc, lo, _, place), texts = _unpack_contexts(table)
        fd, flo, fhi, _ = C.unpacked(table.filter(pa.array([k == W.FOLLOWER for k in table.column("kind").to_pylist()])), W.FOLLOWER, W.RANGE)
        d, p = repeated_starts(h, doc, lo, place, texts, window, part, shallow)
        d, a, z = W.merged_runs(np.concatenate([d, fd]), np.concatenate([p, flo]), np.concatenate([p, fhi]))
        return W.range_table(d, a, z, np.zeros(len(d), np.uint64))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.pieces(batches):
            row, lo, hi, _ = W.range_lists(b)
            row, lo, hi = W.merged_runs(row, lo, hi + window - 1)
            cut: dict[int, list[tuple[int, int]]] = {}
            for r, i, j in zip(row.tolist(), lo.tolist(), hi.tolist(), strict=True):
                cut.setdefault(r, []).append((i, j + 1))
            buf, off = C.text_bytes(b)
            raw = buf.tobytes()
            kept, n_removed, spans = [], [], []
            for r in range(b.num_rows):
                t, gone, at, out = raw[off[r] : off[r + 1]], cut.get(r, []), 0, []
                for i, j in gone:
                    out.append(t[at:i])
                    at = j
                kept.append(b"".join([*out, t[at:]]) if gone else t)
                n_removed.append(sum(j - i for i, j in gone))
                spans.append([{"lo": i, "hi": j} for i, j in gone])
            yield pa.RecordBatch.from_arrays(
                [C.column(b, "doc_id"), pa.array(kept, pa.binary()), pa.array(np.diff(off), pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())])))],
                names=["doc_id", "kept", "n_bytes", "n_removed", "spans"],
            )

    found = docs.mapInArrow(anchors, C.PACKED).groupBy("bucket").applyInArrow(W.repeated_anchors, W.RANGES)
    later = W.with_ranges(docs, found).mapInArrow(contexts, C.PACKED).groupBy("bucket").applyInArrow(repeats, W.RANGES)
    return W.with_ranges(docs, later).mapInArrow(remove, "doc_id long, kept binary, n_bytes long, n_removed long, spans array<struct<lo:int,hi:int>>")


def _anchor_places(buf: np.ndarray, at: np.ndarray, more: np.ndarray, window: int, part: int, h: np.ndarray) -> np.ndarray:
    """Where in each context its anchor is: the one place that all its windows cover with the hash h."""
    reach = window - part + 1
    roll = C.Roll(C.byte_symbols(buf), C.BASES[0])
    # a context of m + 1 windows has its anchor in places m .. reach - 1, so that every window covers it
    n = reach - more
    i, of = W.expand(at + more, at + more + n - 1)
    hit = roll.slices(i, i + part) == h[of]
    first = np.full(len(at), -1, np.int64)
    k = np.flatnonzero(hit)[::-1]
    first[of[k]] = i[k]
    return first - at


def query(spark, sf_dir: str) -> DataFrame:
    d = dedup_suffixes(C.documents(spark, sf_dir))
    return d.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


