"""The corpus operators and the pipeline's stages against brute force, SQL and held-out labels."""

import math
import random
import re
import struct
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.compare import differs, duck
from tidemark.llm import common as C
from tidemark.llm import decontamination as D
from tidemark.llm import embedding_dedup as E
from tidemark.llm import language_id, line_dedup, mixing, ngram_join, queries, secret_scan, substring_dedup, suffix_dedup, toxicity
from tidemark.llm import pipeline as P

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_duckdb(spark, name):
    assert differs(spark, duck(SMALL), queries.queries()[name], queries.oracle_sql()[name], SMALL) == ""


# ------------------------------------------------------------------ hashes


def thue_morse(n, x, y):
    return "".join(y if i.bit_count() & 1 else x for i in range(n))


def test_prime_roll():
    rng = np.random.default_rng(0)
    for sym in (rng.integers(0, 256, 900).astype(np.uint8), rng.integers(0, 1 << 63, 900, dtype=np.uint64)):
        r = C.PrimeRoll(sym, C.BASES[0])
        values = [int(c) + 1 if sym.dtype == np.uint8 else int(c) & C.P61 for c in sym]
        for lo, hi in rng.integers(0, 900, (20, 2)):
            lo, hi = min(lo, hi), max(lo, hi)
            got = C.mulmod(C._join(r.high[[hi]] - r.high[[lo]], r.low[[hi]] - r.low[[lo]]), r.inverse[[lo]])
            assert int(got[0]) == sum(c * pow(C.BASES[0], i, C.P61) for i, c in enumerate(values[lo:hi])) % C.P61


def test_regular_words_do_not_collide(spark):
    x, y = thue_morse(4096, "a", "b"), thue_morse(4096, "b", "a")
    words = [f"w{i}" for i in range(30)]
    d = spark.createDataFrame([(1, " ".join([x, *words])), (2, " ".join([y, *words])), (3, x), (4, y)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in substring_dedup.dedup_substrings(d).collect()}
    assert got == {1: 0, 2: 30, 3: 0, 4: 0}
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_join(d).where("doc_id > 2").collect()} == {3: 3, 4: 4}
    items = spark.createDataFrame([(1, " ".join([x] * 3))], "item_id long, text string")
    texts = spark.createDataFrame([(1, " ".join([y] * 3)), (2, " ".join([x] * 3))], "doc_id long, text string")
    assert [r["doc_id"] for r in D.contaminated(texts, items).collect()] == [2]


# ------------------------------------------------------------------ n-gram join


def shingles(text):
    w = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    return frozenset(tuple(w[p : p + 5]) for p in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])


def least_reachable(sets, linked):
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if linked(sets[a], sets[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def near_copies(a, b):
    k = len(a & b)
    return k > 0 and 100 * k >= 80 * len(a | b)


def families(seed):
    rng, rows = random.Random(seed), []
    for fam in range(5):
        base = [f"f{fam}w{rng.randrange(400)}" for _ in range(rng.choice([6, 12, 60, 140]))]
        for _ in range(rng.choice([5, 30, 90])):
            w = base[:]
            if rng.random() < 0.3:
                at = rng.randrange(len(w) + 1)
                w[at:at] = [f"s{j}" for j in range(30)]
            for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 8])):
                at = rng.randrange(len(w))
                w[at : at + rng.randint(0, 1)] = rng.choice([[], ["x"], [f"q{rng.randrange(60)}"]])
                w = w or ["x"]
            rows.append((len(rows), rng.choice([str.upper, str])(" ".join(w))))
    return rows


@pytest.mark.parametrize("limits", [{}, {"gathered": 3, "block": 16}])
def test_families_of_near_copies(spark, limits):
    rows = families(2)
    sets = {i: shingles(t) for i, t in rows}
    comp = least_reachable(sets, near_copies)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), **limits).collect()}
    assert got == {i: (len(sets[i]), comp[i]) for i in sets}


def test_pairs_of_lists():
    """A pair comes once from a bucket, and only from different components."""
    n = 40
    a = [np.repeat(np.arange(1, 31, dtype=np.uint64), n), np.tile(np.arange(n), 30), np.zeros(30 * n, np.int64), np.full(30 * n, 100, np.uint32), np.full(30 * n, 1, np.uint8), np.full(30 * n, 30, np.uint32), np.zeros(30 * n, np.uint32), np.repeat(np.arange(30, dtype=np.uint64), n), np.zeros(30 * n, np.uint8)]
    pairs = ngram_join.list_pairs(pa.Table.from_batches([C.packed_batch([(0, 0, C.pack(*a))])]), 80, 100)
    assert pairs.num_rows == n * (n - 1) // 2
    a[2] = -a[1]  # all of component 0
    assert ngram_join.list_pairs(pa.Table.from_batches([C.packed_batch([(0, 0, C.pack(*a))])]), 80, 100).num_rows == 0


# ------------------------------------------------------------------ decontamination


def edited(rng, vocab, words, edits):
    y = list(words)
    for _ in range(edits):
        at = rng.randrange(len(y) + 1)
        y[at : at + rng.randint(0, 1)] = rng.choice([[], [rng.choice(vocab)]])
    return y


@pytest.mark.parametrize("m", [3, 7, 8, 15, 30, 59, 120])
def test_decontamination_recall(m):
    rng = random.Random(m)
    vocab = [f"w{i}" for i in range(2000)]
    items = [[rng.choice(vocab) for _ in range(m)] for _ in range(40)]
    it = D.prepare([(i, " ".join(x)) for i, x in enumerate(items)], 0.2, 0.995, 3)
    texts = [[*rng.choices(vocab, k=rng.randrange(60)), *edited(rng, vocab, items[i % 40], int(D.edits_allowed(m, 0.2))), *rng.choices(vocab, k=rng.randrange(60))] for i in range(160)]
    w, off = D.words_of(pa.RecordBatch.from_arrays([pa.array([" ".join(x) for x in texts])], names=["text"]))
    best = [D.least_distance(it.w[it.off[i % 40] : it.off[i % 40 + 1]], w[off[i] : off[i + 1]])[0] for i in range(160)]
    want = {(i, i % 40): d for i, d in enumerate(best) if d <= D.edits_allowed(m, 0.2)}
    got = {k: v[0] for k, v in D.matches_in(it, w, off).items()}
    assert len(want) > 100 and all(got.get(k, d) == d for k, d in want.items())
    assert len(want.keys() & got.keys()) >= 0.99 * len(want)


def test_stock_phrases():
    rng = random.Random(1)
    phrase = [f"s{i}" for i in range(10)]
    it = D.prepare([(i, " ".join([*phrase, *(f"w{rng.randrange(3000)}" for _ in range(rng.choice([5, 10, 20])))])) for i in range(4000)], 0.2, 0.995, 3)
    began = time.time()
    assert D.matches_in(it, *D.words_of(pa.RecordBatch.from_arrays([pa.array([" ".join(phrase * 400)])], names=["text"]))) == {}
    assert time.time() - began < 10


def test_decontamination_in_blocks(spark):
    items = [(i, " ".join(f"i{i}w{j}" for j in range(20))) for i in range(12)] + [(50, None), (51, "two words"), (52, "")]
    texts = [(i, f"start of text {items[i % 12][1].upper()} its end") for i in range(24)] + [(90, None), (None, items[3][1]), (5, items[6][1])]
    d, b = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r[0] is None, r[0], r[1], r[2]) for r in D.contaminated(d, b, block_chars=300).collect())
    assert got == sorted([(False, i, i % 12, 0) for i in range(24)] + [(True, None, 3, 0), (False, 5, 6, 0)], key=lambda r: (r[0], r[1] or 0, r[2]))


# ------------------------------------------------------------------ embeddings


@pytest.mark.parametrize(("dims", "n"), [(8, 500), (16, 1000), (64, 800), (100, 800)])
def test_vectors(spark, dims, n):
    rng = np.random.default_rng(dims)
    x, label = rng.normal(size=(n, dims)) + (dims == 100), rng.integers(0, 3, n)
    of = rng.integers(0, n, n // 2)
    u = rng.normal(size=(n // 2, dims))
    base = x[of] / np.linalg.norm(x[of], axis=1, keepdims=True)
    u -= (u * base).sum(1, keepdims=True) * base
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    c = rng.choice([0.9805, 0.985, 0.99, 0.979], (n // 2, 1))
    x, label = np.concatenate([x, c * base + np.sqrt(1 - c * c) * u]), np.concatenate([label, label[of]])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = (unit @ unit.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(link, False)
    got = {r["vec_id"]: r for r in E.near_vectors(spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, label, strict=True))], "vec_id long, embedding array<double>, label int")).collect()}
    found = np.asarray([got[i]["n_links"] for i in range(len(x))])
    assert (found <= link.sum(1)).all() and found.sum() >= 0.99 * link.sum() > 0
    comp = least_reachable({i: i for i in np.flatnonzero(link.any(1)).tolist()}, lambda a, b: link[a, b])
    assert sum(got[i]["component_id"] == c for i, c in comp.items()) >= 0.98 * len(comp)
    assert all(got[i]["kept"] == (got[i]["component_id"] == i) for i in got)


def test_repeated_ids_and_scales(spark):
    rows = [(5, [1.0, 0.0] * 8, 0), (5, [0.0, 1.0] * 8, 0), (9, [1.0, 0.01] * 8, 0), (1, [1e-200] * 16, 1), (2, [2e-200] * 16, 1), (3, [1e200] * 16, 1), (None, [1.0, 0.0] * 8, 0)]
    got = sorted((r[0] is None, *r) for r in E.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert got == [(False, 1, 2, 1, True), (False, 2, 2, 1, False), (False, 3, 2, 1, False), (False, 5, 0, 5, True), (False, 5, 1, 5, True), (False, 9, 1, 5, False), (True, None, 0, None, True)]


# ------------------------------------------------------------------ learned


def test_filters():
    rng = np.random.default_rng(3)
    members = {f"l{i:03d}": rng.integers(0, 1 << 63, 200, dtype=np.uint64) for i in range(300)}
    f = language_id.BitmaskFilter.build(sorted(members), members)
    some = np.concatenate([members["l007"][:50], members["l299"][:20]])
    counts = f.counts(some, np.asarray([0, 50, 70]))
    assert counts[0].argmax() == 7 and counts[1].argmax() == 299 and counts[0, 7] == pytest.approx(50) and counts[0, 299] < 5
    assert f.masks.nbytes <= language_id.FILTER_BYTES and (f.false_positive() < 0.1).all()


def test_every_label_is_learned(spark):
    texts = [(i, " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{c}" for c in "abcdefgh") * 3, f"lang{i % 300:03d}") for i in range(600)]
    texts = [(i, " ".join(f"{chr(0x4E00 + 40 * (i % 300) + j)}{chr(0x4E00 + 40 * (i % 300) + j + 1)}" for j in range(30)), x) for i, _, x in texts]
    d = spark.createDataFrame([*texts, (900, "xyz qq", None), (None, texts[0][1], "lang000")], "doc_id long, text string, lang string")
    p = language_id.predict(d, language_id.train(d)).where("lang IS NOT NULL").collect()
    assert len({r["lang_pred"] for r in p}) == 300 and all(r["lang_pred"] == r["lang"] for r in p)


def test_languages_are_learned_from_all_rows(spark):
    own = lambda i: " ".join(chr(0x4E00 + 40 * i + j) + chr(0x4E01 + 40 * i + j) for j in range(6))
    rows = [(i, f"w{'ab' if i % 2 else 'xy'} {'cd' if i % 2 else 'uv'}e", f"l{i % 2}") for i in range(8_000)]
    rows += [(10_000 + i, own(i), "l1") for i in range(40)]
    d = spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars int").repartition(5)
    assert P.language(spark, d, SMALL).where("doc_id >= 10000").count() == 40
    model = language_id.train(d)
    p = sorted(r["known"] for r in language_id.predict(d, model).collect())
    for low in (0.0, 0.002, 0.01, 1.0):
        assert language_id.usual(d, model, low) == math.floor(p[max(0, math.ceil(low * len(p)) - 1)] * 10_000) / 10_000


def test_counts_of_tasks_that_hold_few(spark, monkeypatch):
    d = C.documents(spark, SMALL).select("doc_id", "text", "lang").limit(60).coalesce(1)
    rows = d.where("lang IS NOT NULL AND text IS NOT NULL").collect()
    langs = sorted({r["lang"] for r in rows})
    n = {x: Counter(language_id.grams([r["text"] for r in rows if r["lang"] == x])[0].tolist()) for x in langs}
    members = {x: [g for g in n[x] if n[x][g] / n[x].total() >= 0.3 * max(o[g] / o.total() for o in n.values())] for x in langs}
    want = language_id.BitmaskFilter.build(langs, {x: np.asarray(g, np.uint64) for x, g in members.items()})
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for held in (1 << 20, 3_000, 1):
            monkeypatch.setattr(language_id, "HELD", held)
            model = language_id.train(d, top=1 << 20)
            assert model.langs == langs and np.array_equal(model.masks, want.masks)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_held_out_languages(spark):
    d = C.documents(spark, "/root/testdata/sf0.01").select("doc_id", "lang")
    p = language_id.query(spark, "/root/testdata/sf0.01").join(d, "doc_id").where("held_out").collect()
    assert len(p) > 100 and sum(r["lang"] == r["lang_pred"] for r in p) >= 0.98 * len(p) and all(0 <= r["score"] <= 1 for r in p)


def test_held_out_toxicity(spark):
    d, labels = C.documents(spark, "/root/testdata/sf0.1").select("doc_id", "text"), C.table(spark, "/root/testdata/sf0.1", "labels")
    half = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)) == 0
    model = toxicity.train(d, labels.where(half))
    p = toxicity.predict(d.join(labels.where(~half).select("doc_id", F.col("toxic").alias("truth")), "doc_id"), model).where("truth IS NOT NULL").collect()
    # of the toxic labels two in five are of texts without any insult, which nothing in them tells
    insult = re.compile("trash|pathetic|idiot|worthless|disgusting|stupid|clown|scum|loser|moron", re.I)
    told = [r["toxic"] for r in p if r["truth"] == 1 and insult.search(r["text"] or "")]
    assert len(told) > 50 and sum(told) >= 0.85 * len(told)
    clean = [r["toxic"] for r in p if r["truth"] == 0]
    assert sum(clean) <= 0.04 * len(clean)
    high = [r["severity"] for r in p if r["truth"] == 1]
    low = [r["severity"] for r in p if r["truth"] == 0]
    assert np.mean(high) > np.mean(low) + 0.5 and (np.diff(model.thresholds) > 0).all()


def test_labels_that_disagree(spark):
    d = spark.createDataFrame([(i, f"word{i % 5} common text") for i in range(40)] + [(50, None), (51, "")], "doc_id long, text string")
    both = [(i, i % 2) for i in range(40)] + [(0, 1), (2, 1), (None, 1), (99, 1), (3, None)]
    grades = lambda rows: toxicity.gather(d, spark.createDataFrame(rows, "doc_id long, grade int"), 100)[2].sum()
    assert grades(both) == grades(both[::-1]) == 22


# ------------------------------------------------------------------ mixing


def test_positions(spark):
    """taken and position against an order by the hash and a numeric integral of the schedule."""
    rows = [(i, "w " * (i % 9), ["a", "b", "c", "d"][min(i % 7, 3)]) for i in range(300)]
    got = {r["doc_id"]: r for r in mixing.curriculum(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    signed = lambda i: struct.unpack("<q", struct.pack("<Q", xxhash.xxh64(struct.pack("<q", i), seed=42).intdigest()))[0]
    grid = np.linspace(0, 1, 200_001)
    for k, s in enumerate("abcd"):
        own = sorted((signed(i), i) for i, _, x in rows if x == s)
        size, target = sum(i % 9 for _, i in own), got[own[0][1]]["target"]
        knots = mixing.SCHEDULES[k % 3]
        weight = np.interp(grid, np.linspace(0, 1, len(knots)), knots)
        demand = np.concatenate([[0], np.cumsum((weight[1:] + weight[:-1]) / 2)])
        demand /= demand[-1]
        for turn in range(2):
            at = turn * size
            for _, i in own:
                words = max(0, min(round(target) - at, i % 9))
                passes = [p for p in got[i]["passes"] if p["words"]]
                if words:
                    assert passes[turn]["words"] == words and passes[turn]["position"] == pytest.approx(np.interp(at / target, demand, grid), abs=1e-4)
                else:
                    assert len(passes) <= turn
                at += i % 9


def test_rows_without_id_are_spread(spark):
    d = spark.createDataFrame([(None, f"w{i} " * (i % 5), "a") for i in range(400)], "doc_id long, text string, source string")
    assert mixing.sized(d).select("h").distinct().count() > 300 and mixing.curriculum(d).count() == 400


# ------------------------------------------------------------------ edge cases of every operator

WIDE = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in "severity grade toxic lang_pred score known h1 h2 line line_no key n spans blob bucket kind comp tokens component_id taken target size position passes __gone __lang __score path id".split())
LONG = " ".join(f"long{i % 7000}" for i in range(20_000)) + "\n" + "x" * 30_000


def wide(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 1, *["z"] * 29) for i, t, lang in rows], WIDE)


EDGES = [(1, None, None), (2, "", "en"), (3, " \n\t ", "en"), (4, LONG, "en"), (4, LONG, "en"), (5, LONG, "fr"), (None, LONG, None), (None, None, None), (6, "short", "en"), (6, "other", "fr"), (7, "😀é\u0000 12 !", "en")]


def test_edges(spark):
    d = wide(spark, EDGES)
    spans = {r["path"]: len(r["spans"]) for r in secret_scan.scan_versions(d.drop("path").withColumnRenamed("doc_id", "path"), secret_scan.BlobLedger(spark, C.scratch(spark, "ledger"))).collect()}
    assert set(spans.values()) == {0} and len(spans) == 8
    p = {(r["doc_id"], r["lang_pred"] == "und") for r in language_id.predict(d, language_id.train(d)).collect()}
    assert {i for i, und in p if und} == {None, 1, 2, 3}
    t = toxicity.predict(d, toxicity.train(d, spark.createDataFrame([(4, 1), (6, 0), (6, 1), (None, 1)], "doc_id long, toxic int"))).collect()
    assert len(t) == len(EDGES) and all(r["severity"] is not None for r in t)
    s = [(r["doc_id"], r["n_words"], r["n_removed"]) for r in substring_dedup.dedup_substrings(d).collect()]
    assert sorted(x for x in s if x[0] in (4, 5)) == [(4, 20_001, 13_000)] * 2 + [(5, 20_001, 20_001)] and (None, 20_001, 0) in s and len(s) == len(EDGES)
    b = [(r["doc_id"], r["n_removed"]) for r in suffix_dedup.dedup_suffixes(d).collect()]
    n = len(LONG.encode())
    assert (5, n) in b and (None, 0) in b and (1, 0) in b and len(b) == len(EDGES)
    g = [(r["doc_id"], r["component_id"]) for r in ngram_join.ngram_join(d).collect()]
    assert sorted(x for x in g if x[0]) == [(1, 1), (2, 2), (3, 3), (4, 4), (4, 4), (5, 4), (6, 6), (6, 6), (7, 7)] and g.count((None, None)) == 2
    kept = line_dedup.dedup_lines(d, **line_dedup.ALL_LINES)
    assert kept.columns == d.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "2", "3", "4", "4", "None", "None", "6", "6", "7"])
    m = mixing.curriculum(d.drop("size", "target", "taken", "position", "passes")).collect()
    assert len(m) == len(EDGES) and {r["size"] for r in m} == {0, 1, 3, 20_001}
    item = spark.createDataFrame([(1, " ".join(LONG.split()[100:130])), (1, " ".join(LONG.split()[100:130]))], "item_id long, text string")
    assert sorted(str(r["doc_id"]) for r in D.contaminated(d, item).collect()) == ["4", "5", "None"]


def test_empty_tables(spark):
    none = wide(spark, EDGES[:1]).limit(0)
    items = spark.createDataFrame([(1, "one two three four")], "item_id long, text string")
    assert secret_scan.scan_versions(none.drop("path").withColumnRenamed("doc_id", "path"), secret_scan.BlobLedger(spark, C.scratch(spark, "ledger"))).count() == 0
    assert toxicity.predict(none, toxicity.train(none, spark.createDataFrame([], "doc_id long, toxic int"))).count() == 0
    assert D.contaminated(none, items).count() == 0 and D.contaminated(none, items.limit(0)).count() == 0
    for _, stage in P.STAGES:
        out = stage(spark, none.drop("size", "target", "taken", "position", "passes"), SMALL)
        assert out.count() == 0


# ------------------------------------------------------------------ the pipeline's stages


def test_stage_language(spark):
    d = C.documents(spark, "/root/testdata/sf0.01")
    rng = random.Random(3)
    junk = [(10_000 + i, " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(60)), None, "s", 1) for i in range(40)]
    odd = [(20_000, None, "en", "s", 1), (20_001, "12 345", "en", "s", 1)]
    more = spark.createDataFrame([*junk, *odd], "doc_id long, text string, lang string, source string, n_chars int").select(*[F.col(c).cast(t) for c, t in d.dtypes])
    assert {r[0] for r in P.language(spark, d.unionByName(more), SMALL).select("doc_id").collect()} == {r[0] for r in d.select("doc_id").collect()}


def test_stage_near(spark):
    rows = families(4)
    comp = least_reachable({i: shingles(t) for i, t in rows}, near_copies)
    d = spark.createDataFrame([*rows, (None, rows[0][1]), (900, None)], "doc_id long, text string")
    got = sorted(str(r[0]) for r in P.near(spark, d, SMALL).select("doc_id").collect())
    assert got == sorted([*(str(i) for i in comp if comp[i] == i), "None", "900"])


def test_stage_line(spark):
    rng = random.Random(5)
    lines = ["".join(rng.choices("abc é", k=rng.choice([0, 1, 3, 7, 12, 30]))) for _ in range(60)]
    rows = [(i, "\n".join(rng.choices(lines, k=rng.randint(1, 6)))) for i in range(50)]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    before, want = [], {}
    for i, t in rows:
        kept = []
        for x in t.split("\n"):
            blank = not x.encode().split()
            gone = not blank and any(x == y or min(len(x), len(y)) >= 6 and abs(len(x) - len(y)) <= 2 and distance(x, y) <= 2 for y in before)
            kept += [] if gone else [x]
            before.append(x)
        if len(kept) == len(t.split("\n")) or any(x.encode().split() for x in kept):
            want[i] = "\n".join(kept)
    got = {r["doc_id"]: r["text"] for r in P.line(spark, spark.createDataFrame(rows, "doc_id long, text string"), SMALL).collect()}
    assert got == want


def test_line_dedup_takes_short_lines(spark):
    d = spark.createDataFrame([(1, "Les.\n\nabcdef\nab", 5), (2, "own\nLes.\n\nabcxef", 5), (3, "Les.\n\nab", 5), (4, "Led.\nabcdefgh\n  ", 5)], "doc_id long, text string, n_chars long")
    gone = line_dedup.repeated_lines(d, **line_dedup.ALL_LINES).collect()
    assert sorted(tuple(r) for r in gone) == [(2, 1, 1, 0), (2, 3, 1, 2), (3, 0, 1, 0), (3, 2, 1, 3), (4, 1, 1, 2)]
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in P.line(spark, d, "").collect()}
    assert got == {1: ("Les.\n\nabcdef\nab", 15), 2: ("own\n", 4), 4: ("Led.\n  ", 7)}


def test_stages_benchmark_and_mix(spark):
    d = C.documents(spark, SMALL).limit(20)
    item = C.table(spark, SMALL, "benchmark").orderBy("item_id").first()["text"]
    bad = d.limit(3).withColumns({"doc_id": F.col("doc_id") + 100_000, "text": F.concat(F.lit("before it "), F.lit(item), F.lit(" after it"))})
    clean = {r[0] for r in P.benchmark(spark, d, SMALL).select("doc_id").collect()}
    assert {r[0] for r in P.benchmark(spark, d.unionByName(bad), SMALL).select("doc_id").collect()} == clean
    both = P.mix(spark, d, SMALL)
    assert sorted(r[0] for r in both.select("doc_id").collect()) == sorted(r[0] for r in mixing.curriculum(d).where("taken > 0").select("doc_id").collect())
    at = [r["passes"][0]["position"] for r in both.collect()]
    assert at == sorted(at)
