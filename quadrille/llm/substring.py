"""Exact removal of repeated byte strings: a depth-limited radix sort of suffixes.

A suffix matters only through its first SPAN bytes.  Most-significant-digit passes
split the suffixes into groups of equal digits and drop whatever is alone; groups
left after the last digit are exactly the repeated windows.

The first digit is content-defined: of every SPAN - GRAM + 1 neighbouring
GRAM-byte hashes the least one is an anchor, so each window holds an anchor, the
same one in each of its copies.  Windows can only be equal if their anchors and
the offsets to them are.  Anchors (one in about 137 bytes) are dealt by hash; those
that stand once are dropped.  Of an anchor with equal surroundings (no window
reaches farther) only one occurrence goes on.

The further digits narrow the offset: the windows at neighbouring offsets have a
core that all of them hold, and lie in a hull.  A range of offsets whose core no
other occurrence has is dropped; one whose hull another occurrence has, too, is
repeated as a whole; of a core with several hulls, one range of each hull is split
into narrower ranges (WIDTHS), at last into single windows, whose core and hull are
the window.  Each pass is a grouping over all tasks with map-side combining and a
join whose large partitions can be split, for frequent and rare anchors alike, so no
task holds an anchor alone.  Strings are told apart by two 64-bit fingerprints
(anchor and surroundings, core and hull).

Defined results: null texts are empty; nothing is removed from texts shorter than
SPAN; texts that occur more than once, repeated rows included, go entirely if they
are at least SPAN bytes long; overlaps within one text count; an empty table gives
no rows; keys may be null or repeated; extra columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Scratch

SPAN, GRAM = 400, 128
LEFT = SPAN - GRAM  # bytes before an anchor that a window with it can reach
#: Offsets in a range, digit by digit.
WIDTHS = (42, 6, 1)
#: Occurrences whose fingerprints are made together, and texts that a task remembers to write them once.
TOGETHER, SEEN = 1000, 100_000
A = 0x9E3779B97F4A7C15 | 1
A_INVERSE = pow(A, -1, 1 << 64)
TABLE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    if base not in _powers or len(_powers[base]) < n:
        size = max(n, 1 << 17)
        _powers[base] = np.multiply.accumulate(np.append(np.uint64(1), np.full(size - 1, base, np.uint64)))
    return _powers[base][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class Prints:
    """Fingerprints of all substrings of one byte string."""

    def __init__(self, data: bytes):
        b = np.frombuffer(data, np.uint8)
        self.n = len(b)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(TABLE[b] * _power(A, self.n), out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * _power(A_INVERSE, self.n + 1)[start])

    def all(self, size: int) -> np.ndarray:
        return mix((self.sums[size:] - self.sums[:-size]) * _power(A_INVERSE, self.n + 1)[: self.n - size + 1])


def _running(x: np.ndarray, w: int, best, fill) -> np.ndarray:
    """best over x[i : i + w] for every i, by blocks of w."""
    n = len(x) - w + 1
    padded = np.full(-(-len(x) // w) * w + w, fill, x.dtype)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, w)
    ahead = best.accumulate(blocks, axis=1).ravel()
    back = best.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(back[:n], ahead[w - 1 : w - 1 + n])


def anchors(prints: Prints) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the least GRAM-byte hash of every window; all of them at ties."""
    h = prints.all(GRAM)
    w = SPAN - GRAM + 1
    low = _running(h, w, np.minimum, np.uint64(2**64 - 1))
    covered = np.concatenate([np.zeros(w - 1, np.uint64), low, np.zeros(w - 1, np.uint64)])
    at = np.flatnonzero(h == _running(covered, w, np.maximum, np.uint64(0)))
    return at, h[at]


def _around(at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.maximum(at - LEFT, 0), np.minimum(at + SPAN, n)


def _anchored(docs: DataFrame) -> DataFrame:
    """(th, n, marks): anchors with hash h, surroundings' hash c and position p; marks is null where the task has written the text before."""

    def run(batches):
        kind = pa.list_(pa.struct([("h", pa.int64()), ("c", pa.int64()), ("p", pa.int32())]))
        seen: set[bytes] = set()
        for whole in batches:
            for start in range(0, whole.num_rows, 128):
                batch = whole.slice(start, 128)
                size, h_, c_, p_, ends, again = [], [], [], [], [0], []
                for th, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    data = t.encode("utf-8", "surrogatepass")
                    size.append(len(data))
                    again.append(th in seen)
                    count = 0
                    if len(data) >= SPAN and not again[-1]:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(th)
                        prints = Prints(data)
                        at, h = anchors(prints)
                        a, b = _around(at, len(data))
                        h_.append(h.view(np.int64))
                        c_.append((prints.of(a, b) + mix((at - a).astype(np.uint64) * np.uint64(4096) + (b - at).astype(np.uint64))).view(np.int64))
                        p_.append(at.astype(np.int32))
                        count = len(at)
                    ends.append(ends[-1] + count)
                flat = [np.concatenate(x) if x else np.zeros(0, k) for x, k in ((h_, np.int64), (c_, np.int64), (p_, np.int32))]
                marks = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(x) for x in flat], names=["h", "c", "p"]), mask=pa.array(again))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), marks.cast(kind)], names=["th", "n", "marks"])

    return docs.select("th", "text").mapInArrow(run, "th binary, n long, marks array<struct<h:long,c:long,p:int>>")


def _surroundings(rows: DataFrame) -> DataFrame:
    """(h, c, left, body) from (th, text, want array<struct<h,c,p>>), once for each text of a task."""

    def run(batches):
        seen: set[bytes] = set()
        for whole in batches:
            for start in range(0, whole.num_rows, 64):
                batch = whole.slice(start, 64)
                want = batch.column(2)
                h, c, p = (x.to_numpy(zero_copy_only=False) for x in want.flatten().flatten())
                ends = np.append(0, np.cumsum(want.value_lengths().to_numpy(zero_copy_only=False)))
                at, left, body = [], [], []
                for i, (th, t) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                    if th in seen:
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(th)
                    data = t.encode("utf-8", "surrogatepass")
                    own = slice(ends[i], ends[i + 1])
                    a, b = _around(p[own], len(data))
                    at.append(np.arange(ends[i], ends[i + 1]))
                    left.append(p[own] - a)
                    body += [data[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
                at = np.concatenate([np.zeros(0, np.int64), *at])
                left = np.concatenate([np.zeros(0, np.int32), *left]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(h[at], pa.int64()), pa.array(c[at], pa.int64()), pa.array(left), pa.array(body, pa.binary())], names=["h", "c", "left", "body"])

    return rows.select("th", "text", "want").mapInArrow(run, "h long, c long, left int, body binary")


class Occurrences:
    """Anchors with the bytes around them; ranges of window offsets are told apart by their cores and hulls."""

    def __init__(self, h: np.ndarray, left: np.ndarray, bodies: list[bytes]):
        self.h, self.left = h, left.astype(np.int64)
        self.size = np.array(list(map(len, bodies)), np.int64)
        self.base = np.cumsum(self.size) - self.size
        self.prints = Prints(b"".join(bodies))
        #: the least and the greatest offset of a window that lies in the text
        self.low, self.high = np.maximum(self.left + SPAN - self.size, 0), np.minimum(self.left, LEFT)

    def ranges(self, row: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
        """(row, at, core, hull) of the ranges of occurrences that hold a window, the at-th ones of those given; first: their least offsets.

        The core's fingerprint depends on the anchor's hash and the range as well, that
        of the hull on where the text cuts it off.
        """
        last = np.minimum(first + width - 1, LEFT)
        at = np.flatnonzero((first <= self.high[row]) & (last >= self.low[row]))
        row, first, last = row[at], first[at], last[at]
        left, base = self.left[row], self.base[row]
        core = self.prints.of(base + left - first, base + left - last + SPAN)
        core = mix(mix(self.h[row].view(np.uint64) + first.astype(np.uint64) * np.uint64(A)) + core)
        if width == 1:
            return row, at, core, core
        start, stop = np.maximum(left - last, 0), np.minimum(left - first + SPAN, self.size[row])
        clip = (left - start).astype(np.uint64) * np.uint64(4096) + (stop - left).astype(np.uint64)
        return row, at, core, mix(self.prints.of(base + start, base + stop) + clip)


#: Added to the offset of a range that is known to be repeated and goes on for the others' sake.
KNOWN = 1 << 10


def _digit(rows: DataFrame, width: int) -> DataFrame:
    """(h, c, first, core, hull): one digit of the occurrences (h, c, left, body, firsts); firsts are the least offsets of the ranges."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, TOGETHER):
                batch = whole.slice(at, TOGETHER)
                h, c, left = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
                firsts = batch.column(4)
                row = np.repeat(np.arange(len(h)), firsts.value_lengths().to_numpy(zero_copy_only=False))
                asked = firsts.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                row, at, core, hull = Occurrences(h, left, batch.column(3).to_pylist()).ranges(row, asked % KNOWN, width)
                yield pa.RecordBatch.from_arrays([pa.array(h[row]), pa.array(c[row]), pa.array(asked[at].astype(np.int32)), pa.array(core.view(np.int64)), pa.array(hull.view(np.int64))], names=["h", "c", "first", "core", "hull"])

    return rows.select("h", "c", "left", "body", "firsts").mapInArrow(run, "h long, c long, first int, core long, hull long")


def _repeated(around: DataFrame, scratch: Scratch) -> DataFrame:
    """(h, c, lo, hi): repeated bytes from lo up to hi relative to the anchor, for rows (h, c, left, body)."""
    found, starts = None, F.sequence(F.lit(0), F.lit(LEFT), F.lit(WIDTHS[0]))
    active = around.withColumn("firsts", starts)
    for width, after in zip(WIDTHS, (*WIDTHS[1:], 0), strict=True):
        ranges = scratch.keep(_digit(active, width))
        # copies of a text in several tasks give the same surroundings again
        least, most = F.min("c").alias("one"), F.max("c").alias("other")
        same = (F.col("one") != F.col("other")).alias("same")
        if after:
            hulls = ranges.groupBy("core", "hull").agg(least, most)
            cores = ranges.groupBy("core").agg(F.min("hull").alias("_a"), F.max("hull").alias("_b")).select("core", (F.col("_a") != F.col("_b")).alias("several"))
            told = hulls.join(cores, "core").where("one <> other or several").select("core", "hull", same, F.when(F.col("several"), F.col("one")).alias("one"))
        else:  # single windows
            told = ranges.groupBy("core", "hull").agg(least, most).where("one <> other").select("core", "hull", same, F.lit(None).cast("long").alias("one"))
        told = scratch.keep(told)
        ranges, stale = scratch.keep(ranges.join(told.hint("merge"), ["core", "hull"]).select("h", "c", "first", "same", F.coalesce(F.col("c") == F.col("one"), F.lit(False)).alias("on"))), ranges
        scratch.drop(stale, told)
        last = F.least(F.col("first") + (width - 1), F.lit(LEFT))
        part = ranges.where("same").where(F.col("first") < KNOWN).select("h", "c", (-last).alias("lo"), (SPAN - F.col("first")).alias("hi"))
        found = part if found is None else found.union(part)
        if after:  # one range of each hull goes on, where others have the core, too
            first = F.when(F.col("same") & (F.col("first") < KNOWN), F.col("first") + KNOWN).otherwise(F.col("first"))
            split = F.explode(F.transform(F.sequence(F.lit(0), F.lit(width - 1), F.lit(after)), lambda x: first + x))
            firsts = ranges.where("on").select("h", "c", split.alias("_f")).groupBy("h", "c").agg(F.collect_list("_f").alias("firsts"))  # LEFT entries at most
            active = around.join(firsts.hint("merge"), ["h", "c"])
    return found


def merged(spans: Column) -> Column:
    """Sorted spans (lo, hi) with those that meet made one."""

    def add(done: Column, x: Column) -> Column:
        top = F.element_at(done, -1)
        longer = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(top["lo"].alias("lo"), F.greatest(top["hi"], x["hi"]).alias("hi"))))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["hi"] >= x["lo"]), longer).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(spans, F.array().cast("array<struct<lo:int,hi:int>>"), add)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", texts: bool = False) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256[, kept binary]), one row for each input row."""
    scratch = Scratch(docs.sparkSession, "substring")
    body = F.coalesce(F.col(text), F.lit(""))
    source = docs.select(F.col(key).alias("_key"), body.alias("text"), F.unhex(F.md5(body)).alias("th"))
    # one row for each text, with a number of its own
    base = _anchored(source).groupBy("th").agg(F.count("*").alias("copies"), F.min("n").alias("n"), F.first("marks", ignorenulls=True).alias("marks"))
    base = scratch.keep(base.select(F.monotonically_increasing_id().alias("d"), "th", (F.col("copies") > 1).alias("copied"), "n", "marks"))
    marks = base.where(F.col("n") >= SPAN).select("d", "n", F.inline("marks"))
    kinds = scratch.keep(marks.groupBy("h", "c").agg(F.count("*").alias("n"), F.min("d").alias("d"), F.min_by("p", "d").alias("p")))
    many = scratch.keep(kinds.groupBy("h").agg(F.count("*").alias("m")).where("m > 1").select("h"))
    want = kinds.join(many.hint("merge"), "h").groupBy("d").agg(F.collect_list(F.struct("h", "c", "p")).alias("want")).join(base.select("d", "th"), "d").select("th", "want")
    around = scratch.keep(_surroundings(source.select("text", "th").join(want.hint("merge"), "th")))
    whole = kinds.where("n > 1").select("h", "c", F.lit(-LEFT).alias("lo"), F.lit(SPAN).alias("hi"))
    spans = _repeated(around, scratch).union(whole)
    cover = scratch.keep(spans.groupBy("h", "c").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("_s")).select("h", "c", merged(F.col("_s")).alias("spans")))  # LEFT spans at most
    scratch.drop(around, kinds, many)
    hits = marks.join(cover.hint("merge"), ["h", "c"]).select("d", "n", "p", F.explode("spans").alias("s"))
    lo, hi = F.greatest(F.lit(0), F.col("p") + F.col("s.lo")), F.least(F.col("n"), F.col("p") + F.col("s.hi"))
    gone = hits.select("d", lo.cast("int").alias("lo"), hi.cast("int").alias("hi")).where(F.col("hi") - F.col("lo") >= SPAN).groupBy("d").agg(F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("gone"))
    facts = scratch.keep(base.select("d", "th", "copied").join(gone, "d", "left").where("copied or gone is not null").drop("d"))
    scratch.drop(base, cover)
    joined = source.join(facts.hint("merge"), "th", "left").select("_key", "text", F.coalesce("copied", F.lit(False)).alias("copied"), F.col("gone.lo").alias("lo"), F.col("gone.hi").alias("hi"))
    return _digested(joined, docs.schema[key].dataType.simpleString(), key, texts)


def _digested(joined: DataFrame, kind: str, key: str, texts: bool) -> DataFrame:
    names = [key, "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if texts else [])]

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                out = []
                for t, copied, lo, hi in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 4)), strict=True):
                    data = t.encode("utf-8", "surrogatepass")
                    spans = [(0, len(data))] if copied and len(data) >= SPAN else list(zip(lo or (), hi or (), strict=True))
                    kept, pos, runs = [], 0, 0
                    end = None
                    for a, b in spans:
                        if end is None or a > end:
                            kept.append(data[pos:a])
                            runs += 1
                        end = b if end is None else max(end, b)
                        pos = end
                    kept.append(data[pos:])
                    left = b"".join(kept)
                    out.append((len(data), len(data) - len(left), runs, hashlib.sha256(left).hexdigest(), left))
                cols = list(zip(*out, strict=True)) or [()] * 5
                arrays = [batch.column(0), *(pa.array(x, pa.int64()) for x in cols[:3]), pa.array(cols[3], pa.string()), *([pa.array(cols[4], pa.binary())] if texts else [])]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return joined.mapInArrow(run, f"`{key}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts)
