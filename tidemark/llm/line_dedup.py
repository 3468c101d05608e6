"""Line dedup by a segment-partition edit join, in DataFrame functions only.

Lines within k edits of each other share one of k + 1 segments. Each distinct line is cut into k + 1
segments, which are indexed by (line length, segment number, hash of the segment); a line probes the
indexes of its own and of k shorter lengths with the substrings at the few starts that an alignment of
at most k edits allows. Candidates whose counts of characters allow a link are verified by a banded
bit-parallel edit distance: one column of the band of 2k + 1 diagonals is a few operations on a long.

A line goes if an earlier line, by (doc_id, line number), is equal or within k edits; this is judged on
the input. Equal lines are one before the join, with their first place, so a line that a third of all
documents hold is one entry. The edit join compares lines of min_chars characters or more, above
2k + 1. Equal lines need no join: ``equal_chars`` is the length from which lines that are not blank are
removed as equal (default: min_chars). The query and the pipeline take 2k + 2 and 1, so all lines.

Edge cases: NULL texts have no lines; a row without doc_id keeps its lines and is nobody's original;
rows that repeat a doc_id count as one document, whose equal places do not remove each other; other
columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common as C

#: Keys or line ids that a filter of lines may broadcast; beyond it the join shuffles.
BROADCAST_IDS = 500_000

#: What the query and the pipeline compare: the edit join from its least length, equal lines of any length.
K = 2
ALL_LINES = {"k": K, "min_chars": 2 * K + 2, "equal_chars": 1}
#: A line or text with this is not blank.
WORD = r"[^\x20\x09-\x0D]"


def lines(docs: DataFrame, min_chars: int, equal_chars: int | None = None) -> DataFrame:
    d = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    long = F.length("line") >= min_chars
    if equal_chars is not None:
        long = long | (F.length("line") >= equal_chars) & F.col("line").rlike(WORD)
    return d.where(long).withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(1), "line")})


def lookups(k: int) -> list[tuple[int, int, int]]:
    """(d, i, shift): where a line looks for segment i of a line d characters shorter. It can only be
    found within i edits of its start from the left, and within k - i from the right. With d and shift 0
    it is the line's own segment, which the index has."""
    every = [(d, i) for d in range(k + 1) for i in range(k + 1)]
    return [(d, i, shift) for d, i in every for shift in range(max(-i, d - (k - i)), min(i, d + (k - i)) + 1)]


def keyed(d: DataFrame, k: int, min_chars: int) -> DataFrame:
    """h1, h2, line, key, index of lines d. The look-ups are rows of one small expression, which is
    compiled; written out side by side they are beyond the size that the JVM compiles."""
    d = d.select("h1", "h2", "line", F.length("line").alias("n"), F.col("line").cast("binary").alias("raw"))
    d = d.withColumn("ascii", F.length("raw") == F.col("n"))
    at = F.array(*[F.struct(F.lit(x).alias("d"), F.lit(i).alias("i"), F.lit(shift).alias("shift")) for x, i, shift in lookups(k)])
    d = d.select("h1", "h2", "line", "n", "raw", "ascii", F.inline(at)).withColumn("m", F.col("n") - F.col("d"))
    # segment i of k + 1 of a line of m characters; longer ones come last
    d = d.withColumn("over", F.pmod("m", F.lit(k + 1)))
    d = d.withColumns({"size": ((F.col("m") - F.col("over")) / F.lit(k + 1)).cast("int"), "long": F.col("i") - (F.lit(k + 1) - F.col("over"))})
    d = d.withColumns({"start": F.col("i") * F.col("size") + F.greatest("long", F.lit(0)) + 1 + F.col("shift"), "size": F.col("size") + (F.col("long") >= 0).cast("int")})
    d = d.where((F.col("start") >= 1) & (F.col("start") + F.col("size") <= F.col("n") + 1) & (F.col("m") >= min_chars))
    # where all characters are bytes, a part is cut from the bytes
    part = F.when(F.col("ascii"), F.substring(F.col("raw"), F.col("start"), F.col("size"))).otherwise(F.substring("line", F.col("start"), F.col("size")).cast("binary"))
    return d.select("h1", "h2", "line", F.xxhash64("m", "i", part).alias("key"), ((F.col("d") == 0) & (F.col("shift") == 0)).alias("index"))


def signature(line: Column) -> Column:
    """How often each of 32 classes of characters occurs, modulo 4, in Gray code: two bits a class, of
    which one more occurrence flips one. An edit takes away and adds a character at most, so lines within
    k edits have signatures that differ in 2k bits at most."""
    one = F.lit(1).cast("long")

    def step(s: Column, c: Column) -> Column:
        low = F.call_function("shiftleft", one, F.pmod(F.ascii(c), F.lit(32)))
        high = F.call_function("shiftleft", low, F.lit(32))
        same = (s.bitwiseAND(low) == 0) == (s.bitwiseAND(high) == 0)
        return s.bitwiseXOR(F.when(same, low).otherwise(high))

    return F.aggregate(F.split(line, ""), F.lit(0).cast("long"), step)


def banded_distance(x: Column, y: Column, k: int) -> Column:
    """Edit distance of two strings whose lengths differ by at most k < len(x); more than k where it is
    more. Bit b of a word stands for row j + k - 2k - 1 + b of the matrix's column j."""
    return _let(F.split(x, ""), lambda a: _let(F.split(y, ""), lambda b: _banded(a, b, k)))


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _banded(a: Column, b: Column, k: int) -> Column:
    width = 2 * k + 2
    mask, top = (1 << width) - 1, width - 1
    m = F.size(a)
    zero = F.struct(F.lit(((1 << (k + 1)) - 1) << (width - k - 1)).cast("long").alias("vp"), F.lit(0).cast("long").alias("vn"), F.lit(k).alias("dist"))
    windows = F.transform(b, lambda c, j: F.struct(j.alias("j"), c.alias("c")))
    bit = lambda v, i: F.call_function("shiftrightunsigned", v, i).bitwiseAND(F.lit(1).cast("long"))
    inv = lambda v: v.bitwiseXOR(F.lit(mask).cast("long"))
    low = lambda v: v.bitwiseAND(F.lit(mask).cast("long"))

    def step(s: Column, w: Column) -> Column:
        j = w["j"]
        eq = F.lit(0).cast("long")
        for i in range(width):
            eq = eq.bitwiseOR(F.when(F.get(a, j + (k - top + i)) == w["c"], F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))

        def with_eq(e: Column) -> Column:
            d0 = low((e.bitwiseAND(s["vp"]) + s["vp"]).bitwiseXOR(s["vp"])).bitwiseOR(e).bitwiseOR(s["vn"])
            return _let(d0, with_d0)

        def with_d0(d: Column) -> Column:
            hp, hn = s["vn"].bitwiseOR(inv(d.bitwiseOR(s["vp"]))), d.bitwiseAND(s["vp"])
            down = F.shiftrightunsigned(d, 1)
            # down the lowest diagonal until the window's last row is x's last, then along that row
            at = top - 1 - (j - (m - k))
            along = F.when(at >= 0, bit(hp, F.greatest(at, F.lit(0))) - bit(hn, F.greatest(at, F.lit(0)))).otherwise(F.lit(0).cast("long"))
            more = F.when(j < m - k, F.lit(1).cast("long") - bit(d, F.lit(top))).otherwise(along)
            return F.struct(hn.bitwiseOR(inv(down.bitwiseOR(hp))).alias("vp"), down.bitwiseAND(hp).alias("vn"), (s["dist"] + more.cast("int")).alias("dist"))

        return _let(eq, with_eq)

    return F.aggregate(windows, zero, step, lambda s: s["dist"])


def _few(ids: DataFrame) -> bool:
    return ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS


def near_lines(docs: DataFrame, k: int, min_chars: int) -> DataFrame:
    """(a1, a2, b1, b2): hashes of pairs of distinct lines within k edits, each pair once.

    First the keys are found that join different lines: an aggregate of all keys, combined before the
    exchange, so that a line which occurs often is no large group. Only the lines that have such a key
    move further. Where a key joins many lines, pairs whose signatures rule a link out end inside the
    join; the others are written and verified."""
    every = keyed(lines(docs, min_chars), k, min_chars)
    live = every.groupBy("key").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi"), F.max("index").alias("index"))
    live = C.written(live.where("lo < hi AND index").select("key"), "line-keys")
    found = F.collect_set(F.struct("key", "index")).alias("found")  # as many as there are look-ups, at most
    if _few(live):
        text = every.join(F.broadcast(live), "key", "left_semi").groupBy("h1", "h2").agg(F.max("line").alias("line"), found)
    else:  # keys move without texts, then the texts of the lines that are left
        has = C.written(every.select("h1", "h2", "key", "index").distinct().join(live, "key", "left_semi").groupBy("h1", "h2").agg(found), "line-has")
        ids = has.select("h1", "h2")
        one = lines(docs, min_chars).join(F.broadcast(ids) if _few(ids) else ids, ["h1", "h2"], "left_semi")
        text = one.groupBy("h1", "h2").agg(F.max("line").alias("line")).join(has, ["h1", "h2"])
    text = C.written(text, "line-texts")
    has = C.written(text.select("h1", "h2", F.length("line").alias("n"), signature(F.col("line")).alias("sig"), F.inline("found")), "line-signed")
    x, y = has.alias("x"), has.where("index").hint("shuffle_hash").alias("y")
    # one direction finds a pair of equal lengths too
    once = (F.col("x.n") > F.col("y.n")) | (F.col("x.n") == F.col("y.n")) & (F.struct("x.h1", "x.h2") < F.struct("y.h1", "y.h2"))
    allowed = F.bit_count(F.col("x.sig").bitwiseXOR(F.col("y.sig"))) <= 2 * k
    j = x.join(y, (F.col("x.key") == F.col("y.key")) & once & allowed)
    pairs = C.written(j.select(*[F.col(f"{s}.h{i}").alias(f"{t}{i}") for s, t in (("x", "a"), ("y", "b")) for i in (1, 2)]).distinct(), "line-pairs")
    side = lambda x: text.select(F.col("h1").alias(f"{x}1"), F.col("h2").alias(f"{x}2"), F.col("line").alias(f"l{x}"))
    both = pairs.join(side("a"), ["a1", "a2"]).join(side("b"), ["b1", "b2"])
    return both.where(banded_distance(F.col("la"), F.col("lb"), k) <= k).select("a1", "a2", "b1", "b2")


def repeated_lines(docs: DataFrame, k: int = K, min_chars: int = 20, equal_chars: int | None = None) -> DataFrame:
    """doc_id, line_no, of_doc, of_line: each line that goes and the first place of what it repeats."""
    if min_chars <= 2 * k + 1:
        raise ValueError("min_chars must be above 2k + 1")
    own = F.struct("doc_id", "line_no")
    every = C.written(lines(docs, min_chars, equal_chars).select("doc_id", "line_no", "h1", "h2"), "line-places")
    first = C.written(every.groupBy("h1", "h2").agg(F.min(own).alias("own"), F.max(own).alias("last")), "line-first")
    near = C.written(near_lines(docs, k, min_chars), "line-near")
    both = near.unionByName(near.select(F.col("b1").alias("a1"), F.col("b2").alias("a2"), F.col("a1").alias("b1"), F.col("a2").alias("b2")))
    other = both.join(first, F.expr("b1 = h1 AND b2 = h2")).groupBy("a1", "a2").agg(F.min("own").alias("other"))
    # a table of its own: the places of one line, of which a third of all documents may have one, are then
    # a side of a join that Spark can split; lines that remove nothing are left out
    # a table of its own: the places of one line, of which a third of all documents may have one, are then
    # a side of a join that Spark can split; lines that remove nothing are left out
    earliest = first.join(other, F.expr("h1 = a1 AND h2 = a2"), "left").select("h1", "h2", F.least("own", "other").alias("of"), "last")
    earliest = C.written(earliest.where("of < last").drop("last"), "line-earliest")
    return every.join(earliest, ["h1", "h2"]).where(own > F.col("of")).select("doc_id", "line_no", F.col("of.doc_id").alias("of_doc"), F.col("of.line_no").alias("of_line")).distinct()


def dedup_lines(docs: DataFrame, k: int = K, min_chars: int = 20, equal_chars: int | None = None) -> DataFrame:
    """docs without the lines that repeat an earlier one; documents that had text and are left with no
    word go."""
    gone = repeated_lines(docs, k, min_chars, equal_chars).groupBy("doc_id").agg(F.collect_list("line_no").alias("__gone"))
    kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains("__gone", i)), "\n")
    d = docs.drop("__gone").join(gone, "doc_id", "left").withColumn("text", F.when(F.col("__gone").isNull(), F.col("text")).otherwise(kept))
    return d.where(F.col("__gone").isNull() | F.col("text").rlike(WORD)).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    """The lines that go."""
    return repeated_lines(C.documents(spark, sf_dir), **ALL_LINES)
