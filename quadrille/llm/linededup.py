"""Line dedup with content-defined chunks, in DataFrame functions alone.

Lines are hashed; a rolling hash over WINDOW neighbouring line hashes ends a chunk
where it is 0 modulo EVERY, so boundaries depend on content only and fall again
into step after an insertion.  A chunk of at least MIN_LINES lines that occurred
before (smaller document key, then smaller position) is removed once its bytes
have been compared with those of the first occurrence.

Boundaries seldom fall right around a short passage.  With over_words, a line also
goes if it lies in a run of lines with more words than that which occurred before,
whatever surrounds it, one long line included.  Any such run is covered by the
shortest ones inside it, for each first and for each last line, so these alone are
hashed; those whose hash repeats are compared by SHA-256.

Texts are read twice: once to be split into rows of line number, hash and words, a
few bytes for each line, from which window functions over the lines of a document
make chunks and runs in time linear in the lines; and once for the documents that
hold a candidate, to compare bytes.  Hashes are counted with map-side combining, and
what is joined with them is written first, so that a hash of very many lines can be
split among tasks.  Joins of texts and lines are merge joins at every size.

Defined results: a null text stays null, an empty one empty; rows with equal key
and equal text are one document (they lose the same chunks); with a null key, rows
count as documents by their text; a text whose chunks all go becomes empty;
removed_chunks counts the chunks that lost a line and replaces a column of that
name; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch

WINDOW, EVERY, MIN_LINES = 2, 3, 2
#: What the queries give as over_words.
OVER_WORDS = 50
CHUNK, RUN = 0, 1


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_rows(base: DataFrame, text: str, over_words: int | None) -> DataFrame:
    """(_id, i, h, own, chunk[, ahead_n, ahead_sum, back_a, back_sum]): a row for each line i of each document (_id, text).

    h is the line's hash, own its upper 36 bits, chunk the number of its chunk.
    ahead_n lines from here on, and the lines from back_a up to here, are the
    shortest runs of more than over_words words (null: there are not so many);
    their sums are over own.
    """
    rows = base.where(F.col(text).isNotNull()).select("_id", F.posexplode(_lines(F.col(text))).alias("i", "x"))
    words = F.regexp_count("x", F.lit(r"\S+")).cast("long") if over_words is not None else F.lit(0).cast("long")
    rows = rows.select("_id", "i", F.xxhash64("x").alias("h"), words.alias("w"))
    rows = rows.repartition("_id").dropDuplicates(["_id", "i"])  # the partitioning serves all that follows
    lines = Window.partitionBy("_id").orderBy("i")
    so_far, before = lines.rowsBetween(Window.unboundedPreceding, 0), lines.rowsBetween(Window.unboundedPreceding, -1)
    # a line before the first one is the first one
    rolled = [F.coalesce(F.lag("h", k).over(lines) if k else F.col("h"), F.first("h").over(so_far)).bitwiseXOR(F.lit(k)) % 1_000_003 for k in range(WINDOW)]
    ends = (F.col("i") + 1 >= WINDOW) & (F.pmod(F.xxhash64(sum(rolled, F.lit(0))), F.lit(EVERY)) == 0)
    own = F.shiftrightunsigned("h", 28)
    rows = rows.select("_id", "i", "h", "w", own.alias("own"), ends.cast("int").alias("_end"), F.sum(own).over(so_far).alias("part"), F.sum("w").over(so_far).alias("after"))
    rows = rows.withColumn("chunk", F.coalesce(F.sum("_end").over(before), F.lit(0)))
    if over_words is None:
        return rows.select("_id", "i", "h", "own", "chunk")
    rows = rows.withColumn("before", F.col("after") - F.col("w"))
    # i, part and after never fall along a document, so their maxima belong to the last line of a range
    near = Window.partitionBy("_id").orderBy("before").rangeBetween(0, over_words)
    rows = rows.select("*", *(F.max(c).over(near).alias(f"_last_{c}") for c in ("i", "after", "part")))
    far = Window.partitionBy("_id").orderBy("after").rangeBetween(Window.unboundedPreceding, -over_words - 1)
    rows = rows.select("*", *(F.max(c).over(far).alias(f"_prior_{c}") for c in ("i", "part")))
    ahead, back = F.col("_last_after") - F.col("before") > over_words, F.col("after") > over_words
    return rows.select(
        "_id", "i", "h", "own", "chunk",
        F.when(ahead, F.col("_last_i") - F.col("i") + 1).alias("ahead_n"),
        F.when(ahead, F.col("_last_part") - F.col("part") + F.col("own")).alias("ahead_sum"),
        F.when(back, F.coalesce(F.col("_prior_i") + 1, F.lit(0))).alias("back_a"),
        F.when(back, F.col("part") - F.coalesce("_prior_part", F.lit(0))).alias("back_sum"),
    )


def _candidates(lines: DataFrame, min_lines: int, over_words: int | None, scratch: Scratch) -> DataFrame:
    """(_id, kind, a, n): chunks and runs of n lines from line a whose hash occurs at more than one place."""
    chunks = lines.groupBy("_id", "chunk").agg(F.min("i").alias("a"), F.count("*").cast("int").alias("n"), F.sum("own").alias("_s"), F.bit_xor("h").alias("_x")).where(F.col("n") >= min_lines)
    units = chunks.select("_id", F.lit(CHUNK).alias("kind"), "a", "n", F.xxhash64("n", "_s", "_x").alias("hash"))
    if over_words is not None:
        back_n = F.col("i") - F.col("back_a") + 1
        ends = F.array(
            F.struct(F.col("i").alias("a"), F.col("ahead_n").alias("n"), F.xxhash64(F.lit("ahead"), "ahead_n", "ahead_sum", "h").alias("hash")),
            F.struct(F.col("back_a").alias("a"), back_n.alias("n"), F.xxhash64(F.lit("back"), back_n, "back_sum", "h").alias("hash")),
        )
        runs = lines.select("_id", F.explode(ends).alias("u")).where("u.n is not null")
        units = units.union(runs.select("_id", F.lit(RUN), "u.a", "u.n", "u.hash"))
    units = scratch.keep(units)
    place = F.xxhash64("_id", "a")
    again = scratch.keep(units.groupBy("hash").agg(F.min(place).alias("_p"), F.max(place).alias("_q")).where("_p <> _q").select("hash"))
    out = scratch.keep(units.join(again.hint("merge"), "hash").select("_id", "kind", "a", "n"))
    scratch.drop(units, again)
    return out


def _repeated(base: DataFrame, text: str, candidates: DataFrame, scratch: Scratch) -> DataFrame:
    """(_id, a, n): the candidates whose bytes occurred before."""
    wanted = scratch.keep(candidates.groupBy("_id").agg(F.collect_set(F.struct("kind", "a", "n")).alias("_want")))
    found = base.where(F.col(text).isNotNull()).select("_id", F.col(text).alias("_t")).join(wanted.hint("merge"), "_id").select("_id", F.explode("_want").alias("_w"), _lines(F.col("_t")).alias("_ls"))
    body = F.array_join(F.slice("_ls", F.col("_w.a") + 1, F.col("_w.n")), "\n")
    found = found.select("_id", "_w.*", body.alias("_body"))
    at = F.struct("_id", "a")
    found = scratch.keep(found.select("_id", "kind", "a", "n", F.unhex(F.sha2("_body", 256)).alias("_sha"), F.when(F.col("kind") == CHUNK, F.col("_body")).alias("_body")))
    first = scratch.keep(found.groupBy("kind", "_sha").agg(F.min(at).alias("_first"), F.max(at).alias("_last")).where("_first <> _last").select("kind", "_sha", "_first"))
    runs = found.where(F.col("kind") == RUN).drop("_body").join(first.where(F.col("kind") == RUN).drop("kind"), "_sha").where(at != F.col("_first"))
    # the bytes of chunks are compared with those of the first one
    chunks = found.where(F.col("kind") == CHUNK)
    origin = chunks.join(first.where(F.col("kind") == CHUNK).select(F.col("_first._id").alias("_id"), F.col("_first.a").alias("a"), F.col("_sha").alias("_own")), ["_id", "a"]).where("_sha = _own")
    origin = scratch.keep(origin.select("_sha", F.col("_body").alias("_origin"), F.col("_id").alias("_oid"), F.col("a").alias("_oa")).dropDuplicates(["_sha"]))
    same = chunks.join(origin, "_sha").where((F.col("_body") == F.col("_origin")) & ((F.col("a") != F.col("_oa")) | ~F.col("_id").eqNullSafe(F.col("_oid"))))
    out = scratch.keep(same.select("_id", "a", "n").union(runs.select("_id", "a", "n")).distinct())
    scratch.drop(wanted, found, first, origin)
    return out


def _gone(lines: DataFrame, repeated: DataFrame) -> DataFrame:
    """(_id, _gone, _chunks): the lines that go as sorted disjoint intervals (a, z), and the number of chunks that lose one."""
    marks = lines.select("_id", "i", "chunk", F.lit(0).alias("open"), F.lit(1).alias("line"))
    marks = marks.join(repeated.select("_id").distinct(), "_id", "left_semi")
    for at, by in ((F.col("a"), 1), (F.col("a") + F.col("n"), -1)):
        marks = marks.union(repeated.select("_id", at, F.lit(None), F.lit(by), F.lit(0)))
    # at a line, what opens and closes there counts first
    so_far = Window.partitionBy("_id").orderBy("i", "line").rowsBetween(Window.unboundedPreceding, 0)
    gone = marks.withColumn("_n", F.sum("open").over(so_far)).where("line = 1 and _n > 0").select("_id", "i", "chunk")
    rank = F.row_number().over(Window.partitionBy("_id").orderBy("i"))
    before = F.lag("chunk").over(Window.partitionBy("_id").orderBy("i"))
    gone = gone.select("_id", "i", (F.col("i") - rank).alias("_run"), F.coalesce(F.col("chunk") != before, F.lit(True)).cast("int").alias("_new"))
    spans = gone.groupBy("_id", "_run").agg(F.min("i").alias("a"), (F.max("i") + 1).alias("z"), F.sum("_new").alias("_new"))
    return spans.groupBy("_id").agg(F.sort_array(F.collect_list(F.struct("a", "z"))).alias("_gone"), F.sum("_new").cast("int").alias("_chunks"))


def drop_repeated_chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", min_lines: int = MIN_LINES, over_words: int | None = None) -> DataFrame:
    """docs with removed_chunks (int) added and the text without repeated chunks and, with over_words, without repeated runs of lines."""
    scratch = Scratch(docs.sparkSession, "lines")
    kept = [c for c in docs.columns if c != "removed_chunks"]
    inner = {c: f"_c{i}" for i, c in enumerate(kept)}
    base = docs.select(F.struct(F.col(key).alias("k"), F.xxhash64(F.col(text)).alias("h")).alias("_id"), *(F.col(c).alias(inner[c]) for c in kept))
    lines = scratch.keep(line_rows(base, inner[text], over_words))
    candidates = _candidates(lines, min_lines, over_words, scratch)
    repeated = _repeated(base, inner[text], candidates, scratch)
    gone = scratch.keep(_gone(lines, repeated))
    scratch.drop(lines, candidates, repeated)
    out = base.join(gone.hint("merge"), "_id", "left")
    ls = _lines(F.col(inner[text]))
    starts = F.concat(F.array(F.lit(0)), F.transform("_gone", lambda x: x["z"]))
    stops = F.concat(F.transform("_gone", lambda x: x["a"]), F.array(F.size(ls)))
    left = F.flatten(F.zip_with(starts, stops, lambda a, z: F.slice("_ls", a + 1, z - a)))
    out = out.withColumn("_ls", F.when(F.col("_gone").isNotNull(), ls))
    text_out = F.when(F.col("_gone").isNull(), F.col(inner[text])).otherwise(F.array_join(left, "\n"))
    return out.select(*(text_out.alias(text) if c == text else F.col(inner[c]).alias(c) for c in kept), F.coalesce("_chunks", F.lit(0)).alias("removed_chunks"))
