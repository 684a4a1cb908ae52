"""Exact n-gram Jaccard join and its linked groups.

A document is the set of its distinct word n-grams, as 64-bit hashes; equal sets
are one node.  For given sizes Jaccard distance grows with the symmetric difference,
a metric, which no image of it exceeds: a node's sketch of 1024 bits holds the parity
of its hashes in as many classes, and the number of bits in which two sketches differ
is a metric never above the symmetric difference.  Pivots split the nodes of a block
into Voronoi regions of it: each node is at home in the region of its nearest pivot
and a guest in every other region whose pivot is, by the triangle inequality, near
enough that a node at home there may link to it (a window of twice the node's link
radius beyond its nearest pivot, and of once beyond the region's own radius).
Regions with more than LEAF nodes at home are split in the same way again, unless
pivots cannot part them (all nodes about as far from each other as links reach, so
that each is a guest nearly everywhere): such a block stays whole, and a task gets
part of its nodes at home at a time.  Inside a leaf, a pair (a node at home, any node)
is compared by its sets only if sizes, places and sketches allow a link and no group
holds both: all such pairs if they are a few for each node, else first the nearest one
of each node, as long as that joins groups.

Pivots alone cannot tell unrelated texts apart (their distances to any pivot are
all about 1, inside every window), so the first split is by shared rare hashes.
All hashes of all rows are counted in BUCKETS counters, which give one total order
of hashes, rare buckets first.  Of a set with s hashes that links to another one at
most D = s - ceil(percent * s / 100) are missing there, so the first hash that two
linked sets have in common is among the first D + 1 of both: each of these hashes
makes a block; a node stays in a block only where its place in the order allows a
link if nothing before was common; blocks of the same nodes are one.  A passage that
very many texts share comes last in the order and makes blocks only of texts that
hold little else.  No link is lost.  The counters only bring order: collisions
change the blocks, never the links.

Each text is shingled in three scans: for counts, for first hashes and sketches, and
to pack the texts of nodes that share a block (in zstd, about a third of the bytes of
their sets); those are fetched, and shingled again, only for pairs that are compared.
Joins of blocks are merge joins at every size, so large keys can be split.

Defined results: null, empty and wordless texts have an empty set and link with
nothing; fewer than n words are one n-gram; repeated rows are kept, each with its
key; rows are tied to sets, not to keys, so null keys and keys on several texts link
like others; a null key never becomes a component id unless the whole group has no
other; extra columns of docs are not read.
"""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import FEW, Scratch, linked_groups, parts

#: Pivots of a block or region in one round, nodes at home in a region that is not split further, and
#: rows of all regions for each row of a block from which the block stays whole.
PIVOTS, LEAF, GUESTS = 16, 1000, 4
#: Pairs for each node that are compared at once.
PAIRS = 8
#: Longs of a sketch.
SKETCH = 16
#: Texts that are shingled together, and hashes that a worker keeps of sets it has just compared.
TOGETHER, KEPT_HASHES = 128, 1_000_000
#: Nodes that a task remembers to write equal sets once.
SEEN = 100_000
#: Counters of hashes (a fixed size: 8 MB wherever they are held) and counters of one row that carries them.
BUCKETS, PART = 1 << 20, 1 << 10
A = 0x9E3779B97F4A7C15
A_INVERSE = pow(A, -1, 1 << 64)
#: A number for each byte, the same one for A-Z and a-z, and which bytes are white space.
BYTES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
BYTES[65:91] = BYTES[97:123]
BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    if base not in _powers or len(_powers[base]) < n:
        size = max(n, 1 << 18)
        _powers[base] = np.multiply.accumulate(np.append(np.uint64(1), np.full(size - 1, base, np.uint64)))
    return _powers[base][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """For each text the sorted hashes of its distinct n-grams of words [^\\x20\\x09-\\x0D]+, A-Z lower-cased.

    All texts are hashed at once: running sums of byte numbers times powers give the
    hash of any word, and the words' hashes those of the n-grams.
    """
    data = b" ".join([*texts, b""])
    b = np.frombuffer(data, np.uint8)
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(BYTES[b] * _power(A, len(b)), out=sums[1:])
    end = np.flatnonzero(BLANK[b])
    start = np.append(0, end[:-1] + 1)
    start, end = start[end > start], end[end > start]
    word = mix((sums[end] - sums[start]) * _power(A_INVERSE, len(b))[start] + (end - start).astype(np.uint64))
    gram = np.full(max(len(word) - n + 1, 0), n, np.uint64)
    for k in range(n):
        gram = gram * np.uint64(A) + word[k : len(word) - n + 1 + k] if len(gram) else gram
    gram = mix(gram)
    last = np.searchsorted(start, np.cumsum([len(t) + 1 for t in texts]))
    out, a = [], 0
    for z in last.tolist():
        if z - a >= n:
            x = np.sort(gram[a : z - n + 1])
            out.append(x[np.append(True, x[1:] != x[:-1])])
        elif z > a:
            short = np.full(1, z - a, np.uint64)
            for k in range(a, z):
                short = mix(short * np.uint64(A) + word[k : k + 1])
            out.append(short)
        else:
            out.append(np.zeros(0, np.uint64))
        a = z
    return out


def first_hashes(s: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    """The D + 1 hashes of a set that come first in the order: linked sets share one of them."""
    n = len(s)
    seen = counts[s >> np.uint64(44)]  # the upper 20 bits are the bucket; s is sorted, so a stable order breaks ties by hash
    return s[np.argsort(seen, kind="stable")[: n + (-percent * n // 100) + 1]]


def sketch(s: np.ndarray) -> np.ndarray:
    """SKETCH longs: for each class of hashes, whether the set holds an odd number of them."""
    odd = np.bincount((s & np.uint64(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _node(s: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63)


def _texts(column) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") if t else b"" for t in column.to_pylist()]


def _counted(docs: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """(key, n_shingles, node) for each row; for each partition, rows (part, counts) with its counters that are not all 0."""
    kind = docs.schema[key].dataType.simpleString()
    names = ["_key", "n_shingles", "node", "part", "counts"]

    def run(batches):
        key_type, counts = None, np.zeros(BUCKETS, np.uint32)
        for whole in batches:
            key_type = whole.schema.field(0).type
            for batch in parts(whole, 1, TOGETHER):
                sets = shingle_sets(_texts(batch.column(1)), n)
                np.add.at(counts, (np.concatenate(sets) >> np.uint64(44)).astype(np.int64), 1)
                none = [pa.nulls(len(sets), kind) for kind in (pa.int32(), pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(len, sets)), pa.int64()), pa.array([_node(s) if len(s) else None for s in sets], pa.int64()), *none], names=names)
        shares = counts.reshape(-1, PART)
        held = np.flatnonzero(shares.any(axis=1))
        if len(held):
            yield pa.RecordBatch.from_arrays([pa.nulls(len(held), key_type), pa.nulls(len(held), pa.int64()), pa.nulls(len(held), pa.int64()), pa.array(held, pa.int32()), pa.array([shares[i].tobytes() for i in held], pa.binary())], names=names)

    return docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInArrow(run, f"_key {kind}, n_shingles long, node long, part int, counts binary")


def _totals(shares: DataFrame) -> np.ndarray:
    """The counters of all partitions, summed part by part on the executors."""

    def add(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held[part] = held.get(part, 0) + np.frombuffer(counts, np.uint32).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["part", "counts"])

    total = np.zeros((BUCKETS // PART, PART), np.int64)
    for part, counts in shares.repartition("part").mapInArrow(add, "part int, counts binary").collect():  # BUCKETS numbers
        total[part] = np.frombuffer(counts, np.int64)
    return total.ravel()


def _signed(docs: DataFrame, text: str, n: int, percent: int, counts) -> DataFrame:
    """(node, size, sigs, k0..) of the nodes: k0.. is the sketch; a node of several tasks has several rows."""
    names = ["node", "size", "sigs", *(f"k{i}" for i in range(SKETCH))]

    def run(batches):
        seen = set()
        for whole in batches:
            for batch in parts(whole, 0, TOGETHER):
                rows = []
                for s in shingle_sets(_texts(batch.column(0)), n):
                    if len(s) and (node := _node(s)) not in seen:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(node)
                        rows.append((node, len(s), first_hashes(s, counts.value, percent).view(np.int64), sketch(s)))
                columns = list(zip(*rows, strict=True)) or [()] * 4
                bits = np.array(columns[3], np.int64).reshape(-1, SKETCH).T
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.list_(pa.int64())), *map(pa.array, bits)], names=names)

    kinds = "".join(f", k{i} long" for i in range(SKETCH))
    return docs.select(F.col(text).alias("_text")).where("_text is not null").mapInArrow(run, f"node long, size int, sigs array<long>{kinds}")


def _few(nodes: DataFrame) -> DataFrame:
    """Distinct nodes to join with: told to all tasks if they are FEW names of 8 bytes at most, else merged."""
    return F.broadcast(nodes) if nodes.count() <= FEW else nodes.hint("merge")


def _packed(docs: DataFrame, text: str, n: int, nodes: DataFrame) -> DataFrame:
    """(node, z): the texts of the nodes (distinct) in zstd, one for each."""

    def run(batches):
        import zstandard

        pack, seen = zstandard.ZstdCompressor(level=1).compress, set()
        for whole in batches:
            for batch in parts(whole, 0, TOGETHER):
                texts, rows = _texts(batch.column(0)), []
                for t, s in zip(texts, shingle_sets(texts, n), strict=True):
                    if len(s) and (node := _node(s)) not in seen:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(node)
                        rows.append((node, pack(t)))
                columns = list(zip(*rows, strict=True)) or [()] * 2
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.binary())], names=["node", "z"])

    out = docs.select(F.col(text).alias("_text")).where("_text is not null").mapInArrow(run, "node long, z binary")
    return out.join(_few(nodes), "node", "left_semi").dropDuplicates(["node"])


def _measured(pairs: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """(a, b, i, u): intersection and union sizes of the pairs (a, b) of nodes."""
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("z").alias("za")).hint("merge"), "a").join(texts.select(F.col("node").alias("b"), F.col("z").alias("zb")).hint("merge"), "b")

    def run(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        known: OrderedDict[int, np.ndarray] = OrderedDict()
        held = 0
        for whole in batches:
            for batch in parts(whole, 2, TOGETHER, 1 << 18):
                a, b, za, zb = (batch.column(i).to_pylist() for i in range(4))
                new = {k: z for k, z in [*zip(a, za, strict=True), *zip(b, zb, strict=True)] if k not in known}
                for k, s in zip(new, shingle_sets([unpack(z) for z in new.values()], n), strict=True):
                    known[k] = s
                    held += len(s)
                shared = []
                for x, y in zip(a, b, strict=True):
                    s, t = sorted((known[x], known[y]), key=len)
                    place = np.searchsorted(t, s)
                    shared.append(int((t[np.minimum(place, len(t) - 1)] == s).sum()))
                union = [len(known[x]) + len(known[y]) - i for x, y, i in zip(a, b, shared, strict=True)]
                while held > KEPT_HASHES:
                    held -= len(known.popitem(last=False)[1])
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(shared, pa.int32()), pa.array(union, pa.int32())], names=["a", "b", "i", "u"])

    return both.select("a", "b", "za", "zb").mapInArrow(run, "a long, b long, i int, u int")


def _ordered(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _blocks(signed: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(blk, node, size, pos): the blocks of two nodes or more; pos is the number of the set's hashes before the block's own."""
    rows = signed.select("node", "size", F.posexplode("sigs").alias("pos", "blk"))
    shared = scratch.keep(rows.groupBy("blk").agg(F.min("node").alias("_n0"), F.max("node").alias("_n1")).where("_n0 < _n1").select("blk"))
    block = scratch.keep(rows.join(shared.hint("merge"), "blk").groupBy("blk", "node").agg(F.min("size").alias("size"), F.min("pos").alias("pos")))
    low = block.groupBy("blk").agg(F.min("pos").alias("low"))
    able = block.join(low, "blk").where(100 * (F.col("size") - F.col("pos")) >= percent * (F.col("size") + F.col("low"))).drop("low")
    # blocks of the same nodes are one; a node's place there is its first one
    same = able.groupBy("blk").agg(F.count("*").alias("_n"), F.bit_xor(F.xxhash64("node")).alias("_x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("_y")).where("_n > 1")
    same = scratch.keep(same)
    named = same.join(same.groupBy("_n", "_x", "_y").agg(F.min("blk").alias("_one")), ["_n", "_x", "_y"]).select("blk", "_one")
    out = scratch.keep(able.join(scratch.keep(named).hint("merge"), "blk").groupBy(F.col("_one").alias("blk"), "node").agg(F.min("size").alias("size"), F.min("pos").alias("pos")))
    scratch.drop(shared, block, same)
    return out


def _named(rows: DataFrame, by: str, *columns: str) -> DataFrame:
    """rows with blk, and the columns and the sketch with by after their names."""
    return rows.select(*(["blk"] if "blk" in rows.columns else []), *(F.col(c).alias(c + by) for c in (*columns, *(f"k{i}" for i in range(SKETCH)))))


def _apart(x: str, y: str) -> Column:
    """The number of bits in which the sketches of two nodes differ."""
    return sum((F.bit_count(F.col(f"k{i}{x}").bitwiseXOR(F.col(f"k{i}{y}"))) for i in range(1, SKETCH)), F.bit_count(F.col(f"k0{x}").bitwiseXOR(F.col(f"k0{y}"))))


def _may_link(x: str, y: str, percent: int) -> Column:
    """Whether two nodes of a block can link, by sizes, sketches and what comes before the block's hash."""
    both = F.col(f"size{x}") + F.col(f"size{y}")
    i = F.least(F.col(f"size{x}") - F.col(f"pos{x}"), F.col(f"size{y}") - F.col(f"pos{y}"), F.shiftright(both - _apart(x, y), 1))
    # sizes are asked first: they are cheap
    return (100 * F.least(f"size{x}", f"size{y}") >= percent * F.greatest(f"size{x}", f"size{y}")) & (100 * i >= percent * (both - i))


class _Links:
    """What is known of pairs of nodes: those that have been compared, and the groups that links make."""

    def __init__(self, texts: DataFrame, nodes: DataFrame, n: int, percent: int, scratch: Scratch):
        self.texts, self.n, self.scratch = texts, n, scratch
        self.linked = 100 * F.col("i") >= percent * F.col("u")
        self.groups = scratch.keep(nodes.select("node", F.col("node").alias("g")))
        self.done = None

    def learn(self, pairs: DataFrame) -> bool:
        """Compare the pairs (a, b) that are new, and unite the groups that their links join; tells whether there were any."""
        keep, drop = self.scratch.keep, self.scratch.drop
        pairs = pairs.distinct()
        pairs = keep(pairs if self.done is None else pairs.join(self.done, ["a", "b"], "left_anti"))
        self.done = pairs if self.done is None else self.done.union(pairs)
        # only the texts that are asked for travel
        asked = keep(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
        texts = keep(self.texts.join(_few(asked), "node", "left_semi"))
        links = _measured(pairs, texts, self.n).where(self.linked).select("a", "b")
        by = lambda x: self.groups.select(F.col("node").alias(x), F.col("g").alias(f"g{x}"))
        new = keep(links.join(by("a"), "a").join(by("b"), "b").where("ga <> gb").select(*_ordered("ga", "gb")).distinct())
        if found := not new.isEmpty():
            joined = linked_groups(new, self.scratch)
            groups = self.groups.join(joined.select(F.col("id").alias("g"), "component_id"), "g", "left").select("node", F.coalesce("component_id", "g").alias("g"))
            self.groups, stale = keep(groups), self.groups
            drop(stale, joined)
        drop(new, texts, asked)
        return found


def _open(members: DataFrame, links: _Links, percent: int) -> DataFrame:
    """members with their present groups g, of the blocks in which a node at home may link to one of another group."""
    named = members.join(links.groups.hint("merge"), "node")
    block = named.groupBy("blk").agg(F.min("g").alias("_g0"), F.max("g").alias("_g1"), F.max("home").alias("_home"), F.min("pos").alias("_low")).where("_g0 <> _g1 and _home")
    may = 100 * (F.col("size") - F.col("pos")) >= percent * (F.col("size") + F.col("_low"))
    return named.join(block.select("blk", "_low").hint("merge"), "blk").where(may).drop("_low")


def _split(block: DataFrame, sketches: DataFrame, percent: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(blocks that pivots cannot part, the Voronoi regions of the others as blocks), both (blk, node, size, pos, home, k0..)."""
    turn = lambda j: F.xxhash64("node", F.lit(j))
    chosen = block.where("home").groupBy("blk").agg(*(F.min_by("node", turn(j)).alias(f"_p{j}") for j in range(PIVOTS)))
    chosen = chosen.select("blk", F.explode(F.array_distinct(F.array(*(f"_p{j}" for j in range(PIVOTS))))).alias("node"))
    pivots = scratch.keep(_named(chosen.join(sketches, "node"), "p", "node"))
    x = _named(block, "x", "node", "size", "pos", "home")
    far = x.join(pivots, "blk").select("blk", "nodex", "sizex", "homex", F.struct(_apart("x", "p").alias("d"), F.xxhash64("nodex", "nodep").alias("turn"), F.col("nodep").alias("pivot")).alias("to"))
    near = far.groupBy("blk", "nodex").agg(F.min("sizex").alias("size"), F.min("homex").alias("home"), F.sort_array(F.collect_list("to")).alias("by"))  # PIVOTS entries
    radius = F.col("size") * ((100 - percent) / percent)
    first = F.element_at("by", 1)
    near = scratch.keep(near.select("blk", F.col("nodex").alias("node"), "home", first["pivot"].alias("_own"), F.filter("by", lambda p: p["d"] <= first["d"] + 2 * radius + 1e-6).alias("to")))
    parted = scratch.keep(near.groupBy("blk").agg((F.sum(F.size("to")) <= GUESTS * F.count("*")).alias("_ok")).where("_ok").select("blk"))
    region = near.join(parted, "blk").select("blk", "node", "home", "_own", F.explode("to").alias("to"))
    region = region.join(block.drop("home"), ["blk", "node"])
    region = region.select(F.xxhash64("blk", "to.pivot").alias("blk"), (F.col("home") & (F.col("to.pivot") == F.col("_own"))).alias("home"), F.col("to.d").alias("d"), *(c for c in block.columns if c not in ("blk", "home")))
    region = scratch.keep(region)
    reach = scratch.keep(region.where("home").groupBy("blk").agg(F.max("d").alias("_r")))
    out = scratch.keep(region.join(reach, "blk").where(F.col("d") <= F.col("_r") + F.col("size") * ((100 - percent) / percent) + 1e-6).drop("d", "_r"))
    whole = scratch.keep(block.join(parted, "blk", "left_anti"))
    scratch.drop(pivots, near, parted, region, reach)
    return whole, out


def _leaves(block: DataFrame, sketches: DataFrame, links: _Links, percent: int, scratch: Scratch) -> DataFrame:
    """The blocks in which links may be left, with those of more than LEAF nodes at home as regions where pivots part them."""
    leaves = None
    while True:
        block = scratch.keep(_open(block, links, percent).drop("g"))
        large = scratch.keep(block.where("home").groupBy("blk").agg(F.count("*").alias("_n")).where(F.col("_n") > LEAF).select("blk"))
        if large.isEmpty():
            return block if leaves is None else leaves.unionByName(block)
        small = block.join(large, "blk", "left_anti")
        whole, block = _split(scratch.keep(block.join(large, "blk", "left_semi")), sketches, percent, scratch)
        leaves = (small if leaves is None else leaves.unionByName(small)).unionByName(whole)


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """(key, n_shingles, component_id), one row for each input row.

    component_id is the smallest key reachable by links (100 * intersection >=
    percent * union), the row's own included.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram")
    counted = scratch.keep(_counted(docs, key, text, n))
    counts = spark.sparkContext.broadcast(_totals(counted.where("part is not null").select("part", "counts")))
    signed = scratch.keep(_signed(docs, text, n, percent, counts))
    block = _blocks(signed, percent, scratch)
    k = [f"k{i}" for i in range(SKETCH)]
    sketches = scratch.keep(signed.select("node", *k).join(block.select("node").distinct().hint("merge"), "node", "left_semi").dropDuplicates(["node"]))
    scratch.drop(signed)
    texts = scratch.keep(_packed(docs, text, n, sketches.select("node")))
    links = _Links(texts, sketches.select("node"), n, percent, scratch)
    block = block.join(sketches.hint("merge"), "node")

    # each node meets the nearest one of the nodes with the fewest hashes before the block's own: this joins most groups
    pivot = block.groupBy("blk").agg(F.min_by("node", F.col("pos").cast("long") * (1 << 32) + F.col("size")).alias("node"))
    pivot = scratch.keep(_named(pivot.join(block, ["blk", "node"]), "p", "node", "size", "pos"))
    met = _named(block, "x", "node", "size", "pos").join(pivot.hint("merge"), "blk").where("nodex <> nodep").where(_may_link("x", "p", percent))
    links.learn(met.groupBy("nodex").agg(F.min_by("nodep", _apart("x", "p")).alias("nodep")).select(*_ordered("nodex", "nodep")))

    leaves = _leaves(block.withColumn("home", F.lit(True)), sketches, links, percent, scratch)

    def left(rows: DataFrame) -> DataFrame:
        """(nodex, nodey, d): the pairs of a leaf that may link and that no group holds both of."""
        x, y = (_named(r, by, "node", "size", "pos", "g") for r, by in ((rows.where("home"), "x"), (rows, "y")))
        return x.join(y.hint("merge"), "blk").where(F.col("gx") != F.col("gy")).where(_may_link("x", "y", percent)).select("nodex", "nodey", _apart("x", "y").alias("d"))

    while True:
        rows = scratch.keep(_open(leaves, links, percent))
        leaves = rows.drop("g")  # what one group holds by now is not asked again
        best = scratch.keep(left(rows).groupBy("nodex").agg(F.min_by("nodey", "d").alias("nodey"), F.count("*").alias("n")))
        pairs, nodes = best.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
        if pairs <= PAIRS * nodes or not links.learn(best.select(*_ordered("nodex", "nodey"))):
            break
    if pairs:
        links.learn(left(rows).select(*_ordered("nodex", "nodey")))
    base = counted.where("part is null").select("_key", "n_shingles", "node")
    named = base.join(links.groups, "node", "left").select("_key", "n_shingles", F.coalesce("g", "node").alias("_g"))
    low = named.where("_g is not null").groupBy("_g").agg(F.min("_key").alias("_low"))
    return named.join(low, "_g", "left").select(F.col("_key").alias(key), "n_shingles", F.coalesce("_low", "_key").alias("component_id"))
