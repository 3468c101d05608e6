"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, edit check.

Edits are of words. The CGK random walk reads a sequence with a pointer that each step advances or
not, by a random bit of the step and the word it is at; sequences at a small edit distance come to walk
in step, so edit distance becomes Hamming distance of what was read. Each repetition samples places of
the walk; a window and an item of equal samples are a candidate. The number of repetitions follows from
the recall asked for and the agreement of walks measured on the items under the most edits allowed.
Candidates are decided by the exact least edit distance of the item to any part of the text around.

1. Sizes of windows are those of the items, in classes a tenth apart; an item is read up to its class.
2. One pass over the documents keeps the places where a window may be: within e edits an item of m words
   keeps m - 2 - 3e of its word trigrams, so a window with fewer trigrams of any item is of none. The
   trigrams of all items are one Bloom filter of bounded size, so this can only keep too much. It says
   neither which item nor where it lies; what it keeps is written, usually little of the corpus.
3. Items go in blocks of bounded size, one at a time on the driver, against what step 2 kept: windows
   of equal text are one, are embedded, and meet the block's items in the tables of samples. Candidates of
   one item that overlap in a text are one part of it; a part that lacks too many of the item's words
   is no match, the others are decided.

Edge cases: NULL or empty texts and items match nothing, and so do items of fewer than min_words
words, as one or two words occur everywhere; items of fewer than SHORT words match without edits; rows
without doc_id are matched like others; repeated items and documents give repeated matches once; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common as C

#: Text of a block of items, which the driver holds and sends with the closure.
BLOCK_CHARS = 1 << 20
GRAM, WALKS, SAMPLES, PAD = 3, 16, 2, 0
#: Words from which an item may have edits.
SHORT = 8
#: Bits of the Bloom filter of trigrams, by their number: 8 for each, within these.
LEAST_BITS, MOST_BITS, BLOOM_HASHES = 1 << 16, 1 << 28, 3
#: Pairs of words that are compared at once.
CELLS = 1 << 24


def words_of(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, A-Z lowered, and the offsets of texts into them."""
    buf, off = C.text_bytes(b)
    buf = np.where((buf >= 65) & (buf <= 90), buf | 32, buf)
    starts, ends, woff = C.word_spans(buf, off)
    return C.word_hashes(buf, starts, ends), woff


def trigrams(w: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the trigram from each place, and which places have one inside their text."""
    n = len(w) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    i = np.arange(n)
    end = np.repeat(off[1:], np.diff(off))[:n]
    p = np.flatnonzero(i + GRAM <= end)
    return C.Roll(w, C.BASES[0]).slices(p, p + GRAM), p


def edits_allowed(m: np.ndarray | int, share: float) -> np.ndarray:
    m = np.asarray(m)
    return np.where(m < SHORT, 0, np.floor(m * share)).astype(np.int64)


def grams_needed(m: np.ndarray, share: float) -> np.ndarray:
    """Of an item's trigrams, those that edits cannot reach."""
    return np.maximum(m - (GRAM - 1) - GRAM * edits_allowed(m, share), 1)


# ------------------------------------------------------------------ classes of sizes


@dataclass(frozen=True)
class Size:
    """A class of item lengths lo..hi that occur; windows have lo words."""

    lo: int
    hi: int
    need: int
    edits: int

    @property
    def back(self) -> int:
        """Words before and, besides hi, after a start that may belong to a match."""
        return self.edits


def size_classes(lengths: np.ndarray, share: float) -> list[Size]:
    out: list[Size] = []
    lengths = np.unique(lengths)
    at = 0
    while at < len(lengths):
        lo = int(lengths[at])
        end = int(np.searchsorted(lengths, max(lo, int(lo * 1.1)), "right"))
        own = lengths[at:end]
        out.append(Size(lo, int(own[-1]), int(grams_needed(own, share).min()), int(edits_allowed(own, share).max())))
        at = end
    return out


def starts_of(size: Size, member: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Places, as many as words, where a window of the class may begin: enough member trigrams around."""
    n = len(member)
    total = np.concatenate([[0], np.cumsum(member)])
    lo, hi = np.maximum(np.arange(n) - size.back, 0), np.minimum(np.arange(n) + size.hi + size.back, n)
    ok = np.flatnonzero(total[hi] - total[lo] >= size.need)
    if len(ok) and len(off) > 2:  # the same within the own text
        text = np.searchsorted(off, ok, "right") - 1
        lo, hi = np.maximum(lo[ok], off[text]), np.minimum(hi[ok], off[text + 1])
        ok = ok[total[hi] - total[lo] >= size.need]
    return ok


# ------------------------------------------------------------------ embedding and samples


def walks(w: np.ndarray, start: np.ndarray, end: np.ndarray, steps: int, rep: int, want: np.ndarray | None = None) -> np.ndarray:
    """CGK embeddings of the sequences w[start:end], padded at their ends: the wanted ones (default: all)
    of so many steps, sequence by sequence."""
    want = np.arange(steps) if want is None else want
    out = np.zeros((len(want), len(start)), np.uint64)
    if not len(w) or not len(want):
        return out.T
    at, salt = start.copy(), np.uint64((rep * 1_000_003 + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    row = {int(j): i for i, j in enumerate(want)}
    for j in range(int(max(want)) + 1):
        if j % 64 == 0:  # a bit of a word for each of 64 steps, then of another hash of it
            turn = np.uint64(j * 0xD6E8FEB86659FD93 & (1 << 64) - 1)
            bits, padded = C.mix(w ^ salt ^ turn), C.mix(np.asarray([PAD], np.uint64) ^ salt ^ turn)
        inside = at < end
        i = np.minimum(at, len(w) - 1)
        if j in row:
            out[row[j]] = np.where(inside, w[i], np.uint64(PAD))
        at = at + ((np.where(inside, bits[i], padded) >> np.uint64(j % 64)) & np.uint64(1)).astype(np.int64)
    return out.T


def places(rep: int, tables: int, steps: int) -> np.ndarray:
    """tables x SAMPLES sampled steps of a walk."""
    return (np.random.default_rng(1000 + rep).random((tables, SAMPLES)) * steps).astype(np.int64)


def keys(w: np.ndarray, start: np.ndarray, end: np.ndarray, lo: int, tables: int) -> Iterator[np.ndarray]:
    """For each of the tables, the keys of the sequences."""
    each = -(-tables // WALKS)
    for rep in range(-(-tables // each)):
        place = places(rep, each, 2 * lo)
        want = np.unique(place)
        e = walks(w, start, end, 2 * lo, rep, want)
        for t, at in enumerate(np.searchsorted(want, place)):
            h = np.full(len(start), rep * each + t + 1, np.uint64)
            for p in at:
                h = C.mix(h * np.uint64(C.BASES[0]) + e[:, p])
            yield h


def edited(x: np.ndarray, edits: int, rng: np.random.Generator) -> np.ndarray:
    y = list(x)
    for _ in range(edits):
        op, at = rng.integers(3), int(rng.integers(len(y) + 1))
        if op == 0 or not y:
            y.insert(at, rng.integers(1, 1 << 62, dtype=np.uint64))
        elif op == 1:
            y.pop(min(at, len(y) - 1))
        else:
            y[min(at, len(y) - 1)] = rng.integers(1, 1 << 62, dtype=np.uint64)
    return np.asarray(y, np.uint64)


def tables_for(w: np.ndarray, off: np.ndarray, items: np.ndarray, size: Size, share: float, recall: float, trials: int = 1024, seed: int = 9) -> int:
    """Repetitions that reach the recall, from the agreement of the walks of all items of a class and of
    copies under the most edits: the mean, over trials, of the chance to miss, is 1 - recall at most.
    Each item is tried, and so often that there are ``trials`` at least."""
    if not size.edits:
        return 1
    rng = np.random.default_rng(seed)
    own = [w[off[i] : off[i + 1]] for i in np.resize(items, max(trials, len(items))).tolist()]
    pairs = [s for x in own for s in (x, edited(x, int(edits_allowed(len(x), share)), rng))]
    start = np.cumsum([0, *map(len, pairs)])
    end = np.minimum(start[:-1] + size.lo, start[1:])
    chance = []
    for rep in rng.choice(WALKS, 4, replace=False).tolist():
        e = walks(np.concatenate(pairs), start[:-1], end, 2 * size.lo, rep)
        chance.append((e[::2] == e[1::2]).mean(1) ** SAMPLES)
    p = np.stack(chance, 1)
    tables = 1
    while (np.prod((1 - p) ** (tables / p.shape[1]), axis=1)).mean() > 1 - recall:
        tables = tables + max(1, tables // 8)
    return tables


# ------------------------------------------------------------------ items


@dataclass
class Items:
    ids: list
    w: np.ndarray
    off: np.ndarray
    grams: np.ndarray  # sorted, distinct
    sizes: list[Size]
    of_size: list[np.ndarray]  # the items of each class
    tables: list[int]
    share: float


def prepare(rows: list[tuple], share: float, recall: float, min_words: int) -> Items | None:
    b = pa.RecordBatch.from_arrays([pa.array([t for _, t in rows], pa.string())], names=["text"])
    w, off = words_of(b)
    keep = np.flatnonzero(np.diff(off) >= min_words)
    if not len(keep):
        return None
    w, off = np.concatenate([w[off[i] : off[i + 1]] for i in keep]), np.concatenate([[0], np.cumsum(np.diff(off)[keep])])
    sizes = size_classes(np.diff(off), share)
    of = [np.flatnonzero((np.diff(off) >= s.lo) & (np.diff(off) <= s.hi)) for s in sizes]
    tables = [tables_for(w, off, i, s, share, recall) for s, i in zip(sizes, of, strict=True)]
    return Items([rows[i][0] for i in keep], w, off, np.unique(trigrams(w, off)[0]), sizes, of, tables, share)


def least_distance(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Least edit distance of the item to any part of the text, and where that part ends."""
    m = len(item)
    where: dict[int, int] = {}
    for i, c in enumerate(item.tolist()):
        where[c] = where.get(c, 0) | 1 << i
    full, high = (1 << m) - 1, 1 << (m - 1)
    vp, vn, d, best, end = full, 0, m, m, 0
    for j, c in enumerate(text.tolist()):
        eq = where.get(c, 0)
        x = eq | vn
        d0 = (((x & vp) + vp) ^ vp) | x
        hp, hn = vn | (full & ~(d0 | vp)), vp & d0
        d += bool(hp & high) - bool(hn & high)
        hp, hn = (hp << 1) & full, (hn << 1) & full
        vp, vn = hn | (full & ~(d0 | hp)), hp & d0
        if d < best:
            best, end = d, j + 1
    return best, end


def candidates(it: Items, k: int, w: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window, item) pairs of class k that meet in a table, once each."""
    size, own = it.sizes[k], it.of_size[k]
    a = it.off[own]
    mine = keys(it.w, a, np.minimum(a + size.lo, it.off[own + 1]), size.lo, it.tables[k])
    met = np.zeros(0, np.int64)
    waiting: list[np.ndarray] = []
    for x, y in zip(mine, keys(w, start, end, size.lo, it.tables[k]), strict=True):
        order = np.argsort(x, kind="stable")
        lo, hi = np.searchsorted(x[order], y, "left"), np.searchsorted(x[order], y, "right")
        hit = np.flatnonzero(hi > lo)
        n = (hi - lo)[hit]
        of = np.repeat(hit, n)
        item = order[np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[hit], n)]
        waiting.append(of * len(own) + item)
        if sum(map(len, waiting)) > CELLS // 8:
            met, waiting = np.unique(np.concatenate([met, *waiting])), []
    met = np.unique(np.concatenate([met, *waiting]))
    return met // len(own), own[met % len(own)]


def matches_in(it: Items, w: np.ndarray, off: np.ndarray) -> dict[tuple[int, int], tuple[int, int]]:
    """{(text, item): (distance, end of the matched part, in words of the text)}."""
    found: dict[tuple[int, int], tuple[int, int]] = {}
    g, p = trigrams(w, off)
    member = np.zeros(len(w), np.int64)
    if len(g):
        member[p] = it.grams[np.minimum(np.searchsorted(it.grams, g), len(it.grams) - 1)] == g
    roll = C.PrimeRoll(w, C.BASES[0]) if len(w) else None
    for k, size in enumerate(it.sizes):
        start = starts_of(size, member, off)
        if not len(start):
            continue
        text = np.searchsorted(off, start, "right") - 1
        # windows that are equal with all that a match around them may read are one
        lo, hi = np.maximum(start - size.back, off[text]), np.minimum(start + size.hi + 2 * size.back, off[text + 1])
        _, first, of = np.unique(np.stack([roll.slices(lo, hi), (start - lo).astype(np.uint64)]), axis=1, return_index=True, return_inverse=True)
        of = of.ravel()
        s, t = start[first], text[first]
        window, item = candidates(it, k, w, s, np.minimum(s + size.lo, off[t + 1]))
        if not len(window):
            continue
        # the first place of each window in each text, and the parts of a text that places near each other make
        order = np.lexsort((start, text, of))
        order = order[C.groups_of([of[order], text[order]])]
        begin = np.searchsorted(of[order], np.arange(len(first) + 1))
        n = (begin[1:] - begin[:-1])[window]
        at = order[np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[window], n)]
        x, y, z = text[at], np.repeat(item, n), start[at]
        order = np.lexsort((z, y, x))
        x, y, z = x[order], y[order], z[order]
        length = np.diff(it.off)[y]
        e = edits_allowed(length, it.share)
        new = C.groups_of([x, y])
        new[1:] |= np.diff(z) > (length + 3 * e)[1:]
        head = np.flatnonzero(new)
        for i, j in zip(head.tolist(), np.append(head[1:], len(x)).tolist(), strict=True):
            d, q = int(x[i]), int(y[i])
            lo, hi = max(off[d], z[i] - e[i]), min(off[d + 1], z[j - 1] + length[i] + 2 * e[i])
            own, part = it.w[it.off[q] : it.off[q + 1]], w[lo:hi]
            if np.isin(own, part).sum() < length[i] - e[i]:
                continue
            dist, end = least_distance(own, part)
            if dist <= e[i]:
                found[d, q] = min((dist, int(lo - off[d]) + end), found.get((d, q), (dist, 1 << 62)))
    return found


# ------------------------------------------------------------------ what of the documents is looked at


def bloom_slots(g: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    for i in range(BLOOM_HASHES):
        yield (C.mix(g + np.uint64(i * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) & np.uint64(bits - 1)).astype(np.int64)


def read_items(items: DataFrame, share: float, min_words: int) -> tuple[list[Size], np.ndarray]:
    """The classes of sizes, and the Bloom filter of the trigrams, a byte for 8 bits."""

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.pieces(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.diff(words_of(b)[1]), pa.int64())], names=["m"])

    m = items.select("text").mapInArrow(lengths, "m long").where(F.col("m") >= min_words).groupBy("m").count().toArrow()
    sizes = size_classes(m.column("m").to_numpy(), share)
    n_grams = int((m.column("m").to_numpy() * m.column("count").to_numpy()).sum())
    bits = 1 << int(np.clip(np.ceil(np.log2(max(1, 8 * n_grams))), np.log2(LEAST_BITS), np.log2(MOST_BITS)))
    block = min(bits, 1 << 20) // 8

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits, bool)
        for b in C.pieces(batches):
            w, off = words_of(b)
            for s in bloom_slots(trigrams(w, off)[0], bits):
                own[s] = True
        packed = np.packbits(own)
        at = [i for i in range(0, len(packed), block) if packed[i : i + block].any()]
        if at:
            yield pa.RecordBatch.from_arrays([pa.array([i // block for i in at], pa.int32()), pa.array([packed[i : i + block].tobytes() for i in at], pa.binary())], names=["at", "bits"])

    def join(t: pa.Table) -> pa.Table:
        both = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in t.column("bits").to_pylist()])
        return pa.table({"at": t.column("at").slice(0, 1), "bits": pa.array([both.tobytes()], pa.binary())})

    bloom = np.zeros(bits // 8, np.uint8)
    for r in items.select("text").mapInArrow(fill, "at int, bits binary").groupBy("at").applyInArrow(join, "at int, bits binary").collect():
        bloom[r["at"] * block : (r["at"] + 1) * block] = np.frombuffer(r["bits"], np.uint8)
    return sizes, bloom


def regions(docs: DataFrame, sizes: list[Size], bloom, schema: str) -> DataFrame:
    """doc_id, at, words: the parts of documents, as hashes of words from place ``at`` on, that hold
    all windows with enough trigrams and what a match there may read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bloom.value
        for b in C.pieces(batches):
            w, off = words_of(b)
            g, p = trigrams(w, off)
            ok = np.ones(len(g), bool)
            for s in bloom_slots(g, 8 * len(bits)):
                ok &= (bits[s >> 3] >> (7 - (s & 7)).astype(np.uint8)) & 1 == 1
            member = np.zeros(len(w), np.int64)
            member[p[ok]] = 1
            edge = np.zeros(len(w) + 1, np.int64)
            for size in sizes:
                s = starts_of(size, member, off)
                t = np.searchsorted(off, s, "right") - 1
                np.add.at(edge, np.maximum(s - size.back, off[t]), 1)
                np.add.at(edge, np.minimum(s + size.hi + 2 * size.back, off[t + 1]), -1)
            inside = np.cumsum(edge)[:-1] > 0
            doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
            cut = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0) | (np.diff(doc, prepend=-1) != 0)) if len(w) else np.zeros(0, np.int64)
            runs = [(i, j) for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(w)], strict=True) if inside[i]] if len(cut) else []
            if runs:
                of = doc[[i for i, _ in runs]]
                cols = [C.column(b, "doc_id").take(pa.array(of)), pa.array([i - off[d] for (i, _), d in zip(runs, of, strict=True)], pa.int64()), pa.array([w[i:j].tobytes() for i, j in runs], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "at", "words"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def contaminated(docs: DataFrame, items: DataFrame, share: float = 0.2, recall: float = 0.995, min_words: int = GRAM, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, distance (edits of words), end_word: a row for each document and item of which
    it holds a passage within share * words edits. items: item_id, text."""
    if min_words < GRAM:
        raise ValueError(f"min_words must be at least {GRAM}")
    spark = docs.sparkSession
    items = items.where("text IS NOT NULL").select("item_id", F.col("text").cast("string").alias("text"))
    doc_type, item_type = dict(docs.dtypes)["doc_id"], dict(items.dtypes)["item_id"]
    schema = f"doc_id {doc_type}, item_id {item_type}, distance int, end_word int"
    sizes, bloom = read_items(items, share, min_words)
    if not sizes:
        return spark.createDataFrame([], schema)
    kept = C.written(regions(docs, sizes, spark.sparkContext.broadcast(bloom), f"doc_id {doc_type}, at long, words binary"), "decontamination-regions")
    total = items.agg(F.sum(F.length("text"))).first()[0]
    blocks = -(-total // block_chars)
    path = C.scratch(spark, "decontamination-matches")
    for i in range(blocks):
        it = prepare([tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i).collect()], share, recall, min_words)
        if it is None:
            continue
        held = spark.sparkContext.broadcast(it)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            it = held.value
            for b in C.pieces(batches, "words", 1 << 18):
                at, _ = C.longs(b, "at")
                words = [np.frombuffer(x, np.uint64) for x in C.column(b, "words").to_pylist()]
                found = matches_in(it, np.concatenate(words), np.concatenate([[0], np.cumsum([len(x) for x in words])]))
                if found:
                    k = list(found)
                    yield pa.RecordBatch.from_arrays([
                        C.column(b, "doc_id").take(pa.array([d for d, _ in k])), pa.array([it.ids[x] for _, x in k]),
                        pa.array([found[x][0] for x in k], pa.int32()), pa.array([found[x][1] + int(at[x[0]]) for x in k], pa.int32()),
                    ], names=["doc_id", "item_id", "distance", "end_word"])

        kept.mapInArrow(run, schema).write.mode("append").parquet(path)
    matches = spark.read.schema(schema).parquet(path) if blocks and C.exists(spark, path) else spark.createDataFrame([], schema)
    return matches.groupBy("doc_id", "item_id").agg(F.min(F.struct("distance", "end_word")).alias("x")).select("doc_id", "item_id", "x.distance", "x.end_word")


def query(spark, sf_dir: str) -> DataFrame:
    return contaminated(C.documents(spark, sf_dir), C.table(spark, sf_dir, "benchmark"))
