"""N-gram Jaccard join with adaptive multi-match prefixes.

Documents are sets of word shingles; two link at Jaccard similarity >= 0.8. If two sets overlap by O,
their prefixes of |x| - O + l tokens in one global order share at least l tokens. Each document picks
its own l: a longer prefix costs more list entries but asks for l shared tokens, which bounds the
candidates by (list entries) / l. The order is by estimated frequency, from a sketch of fixed size
that counts the shingles of all documents, so common passages come last and rarely into a prefix.

Steps, none of which lists the pairs inside a group of copies:
1. Equal sets form a class, whose smallest doc_id stands for it.
2. Buckets of equal minhashes link each class to the smallest and largest of its bucket, if the exact similarity
   allows it. This settles dense groups with a number of checks that is linear in their size. What is
   left to find are links between different components of this step, completely: nothing is capped or
   sampled.
3. A prefix token whose list has one component only is shared with no document of another. The others
   are marked, with the size of their lists. Lists are gathered by token where the sketch bounds them,
   and counted by aggregates with skew-proof joins where it does not.
4. A pair is taken at the first marked token that both share, if what comes before it in both prefixes,
   which they then do not share, leaves room for the overlap and for the shared prefix tokens that
   their sizes and their l ask for. Common tokens (long lists) are only asked for pairs without a shared
   rare one, so that a document's rare tokens count as lost there: a document with many edits of
   its own drops out of its group's long lists. A token is not the first shared if those before it are
   equal in both. Lists beyond BLOCK documents are dealt out as pairs of blocks.
5. The marked tokens that a pair shares are counted; with enough of them it is verified on exact sets.
   Components are joined.

Edge cases: NULL, empty or blank texts have no shingles and link with nothing; a text of fewer than
k words is one shingle; rows without doc_id are returned and link with nothing; rows that repeat a
doc_id are returned each, and share a component if one of them does; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common as C

#: Minhashes of a document, and which of them make a bucket key together.
N_HASH = 16
KEYS = ((0,), (1,), (2, 3), (4, 5), (6, 7), (8, 9), (10, 11, 12), (13, 14, 15))
#: Equal minhashes below which step 2 doesn't ask for a check; step 3 finds what this leaves out.
LEAST_EQUAL = 9
#: Numbers l of shared prefix tokens to choose from, and the cost of a candidate in list entries.
MATCHES = (1, 2, 4, 8, 16)
CANDIDATE_COST = 200.0
#: Ids that a filter of texts may broadcast; beyond it the join shuffles.
BROADCAST_IDS = 100_000
#: Documents in the list of a rare token, at most; documents of a list that one task pairs.
RARE, BLOCK = 8, 4096
#: Estimated frequency up to which a token's list is gathered in one task.
GATHERED = 1 << 16
#: Pairs with one leader that are verified in one task, about.
PER_LEADER = 256
#: token, doc, component less doc, place in the prefix, set size, l
ENTRY = [np.uint64, np.int64, np.int64, np.uint32, np.uint32, np.uint8]
#: list, doc, component less doc, set size, l, most shared prefix tokens and tokens lost if the list's
#: token is the first shared one, the token before, block of the pair of blocks
LISTED = [np.uint64, np.int64, np.int64, np.uint32, np.uint8, np.uint32, np.uint32, np.uint64, np.uint8]

_MULT = np.random.default_rng(77).integers(1, 1 << 62, N_HASH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(buf: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of each text, with repeats, and the offsets of texts into them."""
    buf = np.where((buf >= 65) & (buf <= 90), buf | 32, buf)
    starts, ends, woff = C.word_spans(buf, off)
    words = np.diff(woff)
    roll = C.PrimeRoll(C.word_hashes(buf, starts, ends), C.BASES[1])
    n = np.where(words >= k, words - k + 1, np.minimum(words, 1))
    soff = np.concatenate([[0], np.cumsum(n)])
    of = np.repeat(np.arange(len(n)), n)
    lo = np.arange(soff[-1]) - soff[of] + woff[of]
    size = np.minimum(words, k)[of]
    return roll.slices(lo, lo + size), soff


def shingle_sets(b: pa.RecordBatch, name: str, k: int) -> list[np.ndarray]:
    h, off = shingle_hashes(*C.text_bytes(b, name), k)
    return [np.unique(h[i:j]) for i, j in zip(off[:-1], off[1:], strict=True)]


SUMMARY = "kind int, doc_id long, n long, s1 long, s2 long, mh array<long>, block int, counts binary"


def summarise(docs: DataFrame, k: int, bits: int) -> DataFrame:
    """kind 0: a row per document with its set's size, 128-bit sum hash and minhashes; kind 1: blocks
    of a partition's frequency sketch."""
    block = 1 << 14

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << bits, np.uint32)
        names = [x.split()[0] for x in SUMMARY.split(", ")]
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.binary()]
        for b in C.pieces(batches):
            sets = shingle_sets(b, "text", k)
            n = np.asarray([len(s) for s in sets])
            u = np.concatenate(sets)
            sketch += np.bincount((u >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits).astype(np.uint32)
            full = np.flatnonzero(n)
            first = (np.cumsum(n) - n)[full]
            s1, s2, mh = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64), np.zeros((len(n), N_HASH), np.uint64)
            if len(full):
                s1[full], s2[full] = np.add.reduceat(u, first), np.add.reduceat(C.mix(u * C.U64(C.BASES[0])), first)
                for i, m in enumerate(_MULT):
                    x = u * m
                    mh[full, i] = np.minimum.reduceat((x ^ (x >> np.uint64(32))) * m, first)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, N_HASH * len(n) + 1, N_HASH), pa.int32()), pa.array(mh.view(np.int64).ravel()))
            z = pa.nulls(len(n), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(n), np.int32)), C.column(b, "doc_id"), pa.array(n, pa.int64()), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), lists, z, pa.nulls(len(n), pa.binary())], names=names)
        at = [i for i in range(0, 1 << bits, block) if sketch[i : i + block].any()]
        if at:
            m = len(at)
            cols = [pa.array([1] * m, types[0]), *[pa.nulls(m, t) for t in types[1:6]], pa.array([i // block for i in at], types[6]), pa.array([C.pack(sketch[i : i + block]) for i in at], types[7])]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.select("doc_id", "text").mapInArrow(run, SUMMARY)


def total_sketch(parts: DataFrame, bits: int) -> np.ndarray:
    """The sum of the partitions' sketches: 2**bits counts, whatever the input."""

    def add(t: pa.Table) -> pa.Table:
        s = sum(C.unpack(x, [np.uint32])[0].astype(np.uint64) for x in t.column("counts").to_pylist())
        return pa.table({"block": t.column("block").slice(0, 1), "counts": pa.array([C.pack(s)], pa.binary())})

    out = np.zeros(1 << bits, np.uint64)
    for r in parts.groupBy("block").applyInArrow(add, "block int, counts binary").collect():
        c = C.unpack(r["counts"], [np.uint64])[0]
        out[r["block"] * len(c) : (r["block"] + 1) * len(c)] = c
    return out


def only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs whose doc_id is among ids, filtered before any exchange if there are few ids."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")


def verified(docs: DataFrame, pairs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets have num * union <= den * intersection. ``pairs`` is a stored table.
    A document b of many pairs is copied for every PER_LEADER of them, so that no task gets them all."""
    need = C.written(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "pair-ids")
    texts = only(docs.select("doc_id", "text"), need)
    copies = pairs.groupBy(F.col("b").alias("of")).agg(F.ceil(F.count(F.lit(1)) / PER_LEADER).cast("int").alias("copies"))
    copies = C.written(copies, "pair-copies")
    dealt = pairs.join(copies, pairs.b == F.col("of")).select("a", "b", F.pmod(F.xxhash64("a"), F.col("copies")).cast("int").alias("copy"))
    leaders = texts.join(copies, texts.doc_id == F.col("of")).select("of", F.col("text").alias("tb"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    left = dealt.join(texts.withColumnRenamed("text", "ta"), dealt.a == texts.doc_id).select("a", "b", "copy", "ta")
    both = left.join(leaders, (left.b == F.col("of")) & (left["copy"] == leaders["copy"])).select("a", "b", "ta", "tb")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.pieces(batches, "ta"):
            ok = []
            for x, y in zip(shingle_sets(b, "ta", k), shingle_sets(b, "tb", k), strict=True):
                i = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(den * i >= num * (len(x) + len(y) - i) > 0)
            yield pa.RecordBatch.from_arrays([C.column(b, "a"), C.column(b, "b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(check, "a long, b long").distinct()


def leader_pairs(reps: DataFrame) -> DataFrame:
    """(a, b): b the smallest or largest document of a bucket of a, likely similar by their minhashes."""
    keys = F.array(*[F.xxhash64(F.lit(i), *[F.col("mh")[j] for j in key]) for i, key in enumerate(KEYS)])
    at = reps.select("doc_id", F.explode(keys).alias("key"))
    lead = at.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("key", F.explode(F.array("lo", "hi")).alias("b"))
    pairs = at.join(lead, "key").where("doc_id <> b").select(F.col("doc_id").alias("a"), "b").distinct()
    mh = reps.select("doc_id", "mh")
    p = pairs.join(mh, pairs.a == mh.doc_id).select("a", "b", F.col("mh").alias("ma"))
    p = p.join(mh, p.b == mh.doc_id)
    equal = F.size(F.filter(F.zip_with("ma", "mh", lambda x, y: x == y), lambda e: e))
    return p.where(equal >= LEAST_EQUAL).select("a", "b")


def prefixes(b: pa.RecordBatch, freq: np.ndarray, bits: int, k: int, num: int, den: int) -> Iterator[tuple[int, int, np.ndarray, int, np.ndarray]]:
    """Row, set size, prefix, l, and the estimated frequencies of the prefix."""
    floor = freq.mean() + 4 * np.sqrt(freq.mean())
    for r, s in enumerate(shingle_sets(b, "text", k)):
        n = len(s)
        if not n:
            continue
        est = freq[(s >> np.uint64(64 - bits)).astype(np.int64)]
        order = np.lexsort((s, est))
        base = n - (num * n + den - 1) // den
        cost = np.cumsum(np.maximum(est[order].astype(np.float64) - floor, 0.0))
        best = min(MATCHES, key=lambda m: cost[min(base + m, n) - 1] * (1 + CANDIDATE_COST / m))
        best = min(best, n - base)
        order = order[: base + best]
        yield r, n, s[order], best, est[order]


MARKED = "doc_id long, comp long, n int, best int, place int, token long, size long"
_MARKED_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
_MARKED_NAMES = [x.split()[0] for x in MARKED.split(", ")]


def marked_tokens(docs: DataFrame, counts, bits: int, k: int, num: int, den: int, n_buckets: int, gathered: int) -> DataFrame:
    """MARKED rows: the prefix tokens that documents of more than one component have. docs: doc_id,
    text, comp."""
    packed = "bucket int, kind int, blob binary"
    names = ["bucket", "kind", "blob", *_MARKED_NAMES[:6]]
    types = [pa.int32(), pa.int32(), pa.binary(), *_MARKED_TYPES[:6]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.pieces(batches):
            ids, comp = C.longs(b, "doc_id")[0], C.longs(b, "comp")[0]
            cols: list[list[np.ndarray]] = [[] for _ in range(7)]
            for r, n, t, best, est in prefixes(b, counts.value, bits, k, num, den):
                full = lambda x, kind: np.full(len(t), x, kind)  # noqa: E731, B023
                for c, x in zip(cols, (t, full(ids[r], np.int64), full(comp[r] - ids[r], np.int64), np.arange(len(t), dtype=np.uint32), full(n, np.uint32), full(best, np.uint8), est > gathered), strict=True):
                    c.append(x)
            if not cols[0]:
                continue
            *a, hot = [np.concatenate(c) for c in cols]
            cold = [x[~hot] for x in a]
            rows = [(i, 0, C.pack(*x)) for i, x in C.by_bucket((cold[0] % np.uint64(n_buckets)).astype(np.int64), *cold)]
            if rows:
                yield pa.RecordBatch.from_arrays([*C.packed_batch(rows).columns, *[pa.nulls(len(rows), x) for x in types[3:]]], names=names)
            if hot.any():
                t, doc, delta, place, n, best = (x[hot] for x in a)
                m = len(t)
                own = [doc, doc + delta, n.astype(np.int32), best.astype(np.int32), place.astype(np.int32), t.view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int32()), pa.array(np.ones(m, np.int32)), pa.nulls(m, pa.binary()), *[pa.array(x, y) for x, y in zip(own, types[3:], strict=True)]], names=names)

    def mark(table: pa.Table) -> pa.Table:
        t, doc, delta, place, n, best = C.unpacked(table, 0, ENTRY)
        order = np.argsort(t, kind="stable")
        t, comp = t[order], (doc + delta)[order]
        first = np.flatnonzero(C.groups_of([t]))
        if not len(first):
            return pa.table([pa.nulls(0, x) for x in _MARKED_TYPES], names=_MARKED_NAMES)
        size = np.diff(np.append(first, len(t)))
        mixed = np.maximum.reduceat(comp, first) != np.minimum.reduceat(comp, first)
        sel = np.repeat(mixed, size)
        at = order[sel]
        out = [doc[at], comp[sel], n[at], best[at], place[at], t[sel].view(np.int64), np.repeat(size, size)[sel]]
        return pa.table([pa.array(x.astype(y.to_pandas_dtype()), y) for x, y in zip(out, _MARKED_TYPES, strict=True)], names=_MARKED_NAMES)

    raw = C.written(docs.select("doc_id", "text", "comp").mapInArrow(run, f"{packed}, {', '.join(MARKED.split(', ')[:6])}"), "ngram-entries")
    few = raw.where("kind = 0").select("bucket", "kind", "blob").groupBy("bucket").applyInArrow(mark, MARKED)
    hot = raw.where("kind = 1").select(*_MARKED_NAMES[:6])
    lists = hot.groupBy("token").agg(F.count(F.lit(1)).alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("token", "size")
    return few.unionByName(hot.join(lists, "token").select(*_MARKED_NAMES))


def prefix_lists(marked: DataFrame, num: int, den: int, n_buckets: int, block: int) -> DataFrame:
    """The packed LISTED entries. marked: doc_id, comp, n, best, tokens: array of (place, token, size) by
    place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ids, comp, n, best = (C.longs(b, x)[0] for x in ("doc_id", "comp", "n", "best"))
            c = C.column(b, "tokens")
            m = pc.list_value_length(c).to_numpy(zero_copy_only=False).astype(np.int64)
            place, token, size = (c.flatten().field(x).to_numpy(zero_copy_only=False) for x in ("place", "token", "size"))
            token = token.astype(np.int64).view(np.uint64)
            row = np.repeat(np.arange(len(m)), m)
            start = np.repeat(np.cumsum(m) - m, m)
            at = np.arange(len(row)) - start
            rare = size <= RARE
            total = np.concatenate([[0], np.cumsum(~rare)])
            common = total[:-1] - total[start]  # common marked tokens before this one
            commons = (total[np.cumsum(m)] - total[np.cumsum(m) - m])[row]
            room = np.where(rare, m[row] - (at - common), commons - common)
            lost = np.where(rare, place - common, place)
            before = np.zeros(len(row), np.uint64)
            for kind in (rare, ~rare):
                i = np.flatnonzero(kind)
                same = row[i[1:]] == row[i[:-1]]
                before[i[1:][same]] = token[i[:-1][same]]
            # rows that repeat a doc_id have mingled places
            again = np.flatnonzero((row[1:] == row[:-1]) & (place[1:] == place[:-1]))
            before[np.isin(row, row[again])] = 0
            # what is lost must leave an overlap that some partner's size allows
            keep = np.flatnonzero((n[row] - lost >= (num * n[row] + den - 1) // den) & (room > 0))
            blocks = -(-size[keep] // block)
            own = (C.mix(ids[row[keep]].view(np.uint64)) % blocks.astype(np.uint64)).astype(np.int64)
            of = np.repeat(np.arange(len(keep)), blocks)
            other = np.arange(len(of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            low, high = np.minimum(own[of], other), np.maximum(own[of], other)
            e = keep[of]
            r = row[e]
            lists = C.mix(token[e] ^ C.mix((low << 32 | high).astype(np.uint64))) if len(e) else token[e]
            a = [lists, ids[r], comp[r] - ids[r], n[r].astype(np.uint32), best[r].astype(np.uint8), room[e].astype(np.uint32), lost[e].astype(np.uint32), before[e], ((low != high) * (1 + (own[of] == high))).astype(np.uint8)]
            rows = [(i, 0, C.pack(*x)) for i, x in C.by_bucket((lists % np.uint64(n_buckets)).astype(np.int64), *a)]
            if rows:
                yield C.packed_batch(rows)

    return marked.mapInArrow(run, C.PACKED)


def list_pairs(table: pa.Table, num: int, den: int) -> pa.Table:
    """(a, b), once each: the pairs of a bucket's lists that step 4 takes."""
    t, doc, delta, n, best, room, lost, before, side = C.unpacked(table, 0, LISTED)
    comp = doc + delta
    n, best, room, lost = (x.astype(np.int64) for x in (n, best, room, lost))
    order = np.lexsort((doc, comp, t))
    t, doc, comp, n, best, room, lost, before, side = (x[order] for x in (t, doc, comp, n, best, room, lost, before, side))
    first = np.flatnonzero(C.groups_of([t]))
    size = np.diff(np.append(first, len(t)))
    out: list[np.ndarray] = []

    def take(i: np.ndarray, j: np.ndarray) -> None:
        a, b = n[i], n[j]
        least, need = needed(a, b, best[i], best[j], num, den)
        ok = (comp[i] != comp[j]) & (den * np.minimum(a, b) >= num * np.maximum(a, b)) & (np.minimum(room[i], room[j]) >= need)
        ok &= (np.minimum(a - lost[i], b - lost[j]) >= least) & ((before[i] != before[j]) | (before[i] == 0)) & ((side[i] == 0) | (side[i] != side[j]))
        if ok.any():
            x, y = doc[i[ok]], doc[j[ok]]
            out.append(np.stack([np.minimum(x, y), np.maximum(x, y)], 1))

    if len(first):
        mixed = np.maximum.reduceat(comp, first) != np.minimum.reduceat(comp, first)
        for s in np.unique(size[mixed & (size <= 64)]):  # lists of one size at once
            at = first[mixed & (size == s)]
            x, y = np.triu_indices(int(s), 1)
            step = max(1, (1 << 20) // len(x))
            for p in range(0, len(at), step):
                take((at[p : p + step, None] + x).ravel(), (at[p : p + step, None] + y).ravel())
        for f, s in zip(first[mixed & (size > 64)], size[mixed & (size > 64)], strict=True):
            # the largest component first: its documents are only compared with others
            c = comp[f : f + s]
            head, run = np.flatnonzero(C.groups_of([c])), np.diff(np.append(np.flatnonzero(C.groups_of([c])), s))
            big = int(run.argmax())
            members = f + np.concatenate([np.arange(head[big], head[big] + run[big]), np.arange(head[big]), np.arange(head[big] + run[big], s)])
            step = max(1, (1 << 20) // int(s))
            for p in range(int(run[big]), int(s), step):
                q = min(p + step, int(s))
                i, j = np.divmod(np.arange((q - p) * q), q)
                earlier = j < i + p
                take(members[i[earlier] + p], members[j[earlier]])
    pairs = np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)
    return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})


def needed(a, b, best_a, best_b, num, den):
    """The least overlap that two sizes ask for, and how much of it lies in both prefixes: what is behind
    the prefix that ends first cannot be more than the longer of both rests."""
    least = (num * (a + b) + num + den - 1) // (num + den)
    rest = np.maximum((num * a + den - 1) // den - best_a, (num * b + den - 1) // den - best_b)
    return least, least - rest


def counted(pairs: DataFrame, marked: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs whose prefixes share as many tokens as their sizes and their l ask for."""
    own = lambda x: marked.select(F.col("doc_id").alias(x), F.col("n").alias(f"n{x}"), F.col("best").alias(f"l{x}"), F.col("tokens.token").alias(f"t{x}"))
    j = pairs.join(own("a"), "a").join(own("b"), "b")
    least = F.expr(f"({num} * (na + nb) + {num + den - 1}) div {num + den}")
    rest = F.expr(f"greatest(({num} * na + {den - 1}) div {den} - la, ({num} * nb + {den - 1}) div {den} - lb)")
    return j.where(F.size(F.array_intersect("ta", "tb")) >= least - rest).select("a", "b").distinct()


def ngram_join(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, bits: int = 20, gathered: int = GATHERED, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, class_id (smallest doc_id with an equal set), component_id (smallest doc_id
    reachable by links of intersection / union >= num / den)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n_buckets = 4 * C.partitions(docs)
    summary = C.written(summarise(docs, k, bits), "ngram-summary")
    rows = summary.where("kind = 0")
    linked = rows.where("n > 0 AND doc_id IS NOT NULL")
    counts = spark.sparkContext.broadcast(total_sketch(summary.where("kind = 1").select("block", "counts"), bits))

    classes = C.written(linked.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("class_id")), "ngram-classes")
    ids = classes.select(F.col("class_id").alias("doc_id"), "n", "s1", "s2")
    reps = C.written(linked.join(ids, ["doc_id", "n", "s1", "s2"], "left_semi").select("doc_id", "n", "mh").dropDuplicates(["doc_id", "n"]), "ngram-reps")

    near = C.written(verified(docs, C.written(leader_pairs(reps), "ngram-leaders"), k, num, den), "ngram-near")
    comp = C.components(near, "ngram-near")

    # which texts enter the prefix join: one of each class, with the component so far
    skip = rows.where("n > 0").select("doc_id").join(reps.select("doc_id"), "doc_id", "left_anti").select("doc_id", F.lit(None).cast("long").alias("comp"))
    known = C.written(skip.where("doc_id IS NOT NULL").unionByName(comp.select(F.col("id").alias("doc_id"), F.col("component_id").alias("comp"))).withColumn("known", F.lit(True)).dropDuplicates(["doc_id"]), "ngram-known")
    few = known.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    told = docs.where("doc_id IS NOT NULL").join(F.broadcast(known) if few else known, "doc_id", "left").withColumn("comp", F.when(F.col("known"), F.col("comp")).otherwise(F.col("doc_id"))).where("comp IS NOT NULL")
    tokens = F.array_sort(F.collect_list(F.struct("place", "token", "size"))).alias("tokens")
    marked = C.written(marked_tokens(told, counts, bits, k, num, den, n_buckets, gathered).groupBy("doc_id", "comp", "n", "best").agg(tokens), "ngram-marked")
    pairs = prefix_lists(marked, num, den, n_buckets, block).groupBy("bucket").applyInArrow(lambda t: list_pairs(t, num, den), "a long, b long")
    pairs = C.written(counted(pairs.distinct(), marked, num, den), "ngram-pairs")
    far = C.written(verified(docs, pairs, k, num, den), "ngram-far")
    comp = C.components(near.unionByName(far), "ngram")

    member = rows.select("doc_id", "n", "s1", "s2").join(classes, ["n", "s1", "s2"], "left")
    out = member.join(comp.select(F.col("id").alias("class_id"), "component_id"), "class_id", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("class_id"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", own)).alias("component_id"))


def query(spark, sf_dir: str) -> DataFrame:
    return ngram_join(C.documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")
