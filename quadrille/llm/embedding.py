"""Near-duplicate vectors on robust-pruned flat graphs.

Bitwise equal vectors are one node, with a number of its own.  Sampled vectors are
cluster centres; a node is at home in the shard of its nearest centre and lies in
those of its BUILD nearest ones, so shards overlap.  Each shard builds a flat graph:
candidate neighbours pruned by the robust rule (drop a candidate that is ALPHA times
closer to a kept neighbour than to the node) and reverse edges.  The adjacency lists
of a node from all its shards are united.  Every node searches the shards of its
PROBE nearest centres: greedy steps with a beam from the medoid, and from itself
where it lies in the shard, then range expansion: as long as nodes within the
threshold turn up, their neighbours are visited too.  Whatever is returned has its cosine computed in double precision.

However many centres a dense group has, all of them are searched: each shard knows
the largest angle (of at most CLOSE times the threshold's) at which one of its close
nodes lies from the centre, and every node that by the triangle inequality can be
within the threshold of one such node is compared with all close nodes at home there.
The graphs serve the links between nodes that lie farther from every centre.

A task gives counts for its nodes and links that join the same groups, no pairs, so a
dense group costs rows in proportion to its nodes; pairs are only written for links
that a graph finds, which several shards may find.  A shard of more than SHARD nodes
is split by hash, and searched in all its parts; the nodes compared with a shard are
split likewise, so no task holds an unbounded group.  recall() compares with brute
force.

Defined results: null, zero or non-finite vectors (or such components) link with
nothing; vectors of different length never link; an empty table gives no rows;
repeated rows count as further vectors; keys may be repeated or null (a group's
component_id is its smallest key; a row of a group without any key has null, and is
not kept); extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, linked_groups

#: Nodes of a shard; most centres (all are held by every task); overlap; shards searched.
SHARD, CENTRES, BUILD, PROBE = 1500, 4096, 2, 4
DEGREE, WIDE, POOL, ALPHA, BEAM, STEPS = 16, 6, 48, 1.2, 12, 24
#: Nodes up to this many times the threshold's angle from their centre are found by the bound.
CLOSE = 1.5


def robust_graph(x: np.ndarray, threshold: float) -> np.ndarray:
    """Neighbour lists (rows padded with the node itself) of unit vectors.

    A node with many others within the threshold also gets WIDE of them at random:
    pruned edges alone can leave parts of a dense group without a way to each other.
    """
    n = len(x)
    pool = min(POOL, n - 1)
    if pool <= 0:
        return np.zeros((n, 1), np.int64)
    near = np.empty((n, pool), np.int64)
    wide, dice = np.tile(np.arange(n)[:, None], (1, WIDE)), np.random.default_rng(n)
    for s in range(0, n, 512):
        sims = x[s : s + 512] @ x.T
        sims[np.arange(len(sims)), np.arange(s, s + len(sims))] = -2
        within = sims >= threshold
        many = np.flatnonzero(within.sum(1) > max(WIDE, DEGREE // 2))
        if len(many):
            turn = np.where(within[many], dice.random((len(many), n)), 2.0)
            wide[s + many] = np.argpartition(turn, WIDE - 1, axis=1)[:, :WIDE]
        top = np.argpartition(-sims, pool - 1, axis=1)[:, :pool] if pool < n - 1 else np.argsort(-sims, axis=1)[:, :pool]
        near[s : s + 512] = np.take_along_axis(top, np.argsort(-np.take_along_axis(sims, top, 1), axis=1), 1)
    out = np.full((n, 2 * DEGREE), -1, np.int64)
    for s in range(0, n, 512):
        c = near[s : s + 512]
        own = 1 - np.einsum("ijd,id->ij", x[c], x[s : s + 512])
        among = 1 - np.einsum("ijd,ikd->ijk", x[c], x[c])
        alive, taken = np.ones(c.shape, bool), np.zeros(len(c), np.int64)
        r = np.arange(len(c))
        for j in range(pool):
            use = alive[:, j] & (taken < DEGREE)
            out[s + r[use], taken[use]] = c[use, j]
            taken += use
            alive &= ~(use[:, None] & (ALPHA * among[:, j] <= own))
    # reverse edges where there is room; the nearest neighbour always stays reachable
    a, b = np.nonzero(out[:, :DEGREE] >= 0)
    source, target = np.append(a, np.arange(n)), np.append(out[a, b], near[:, 0])
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    rank = np.arange(len(target)) - np.searchsorted(target, target)
    room = rank < DEGREE
    out[target[room], DEGREE + rank[room]] = source[room]
    return np.concatenate([np.where(out < 0, np.arange(n)[:, None], out), wide], axis=1)


def places(names: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Where each asked name stands in names, -1 if it does not."""
    order = np.argsort(names)
    at = order[np.minimum(np.searchsorted(names[order], asked), len(names) - 1)]
    return np.where(names[at] == asked, at, -1)


def neighbours(names: np.ndarray, lists) -> np.ndarray:
    """Adjacency lists (arrays of node names, or null) as places in names, without those that are not there; rows padded with the node itself."""
    lists = [np.zeros(0, np.int64) if x is None else np.asarray(x, np.int64) for x in lists]
    row, flat = np.repeat(np.arange(len(names)), [len(x) for x in lists]), np.concatenate([np.zeros(0, np.int64), *lists])
    at = places(names, flat)
    row, at = row[at >= 0], at[at >= 0]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    out = np.tile(np.arange(len(names))[:, None], (1, max(1, rank.max(initial=-1) + 1)))
    out[row, rank] = at
    return out


def range_search(x: np.ndarray, graph: np.ndarray, q: np.ndarray, threshold: float, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) pairs with similarity of at least the threshold that greedy search and range expansion reach.

    The search begins at the medoid and, where a query is itself a node (own, else -1), there as well.
    """
    n, m = len(x), len(q)
    medoid = int(np.argmax(x @ x.mean(0)))
    seen = np.zeros((m, n), bool)
    beam, sims = np.full((m, BEAM), medoid), np.full((m, BEAM), -2.0)
    sims[:, 0] = q @ x[medoid]
    done = np.ones((m, BEAM), bool)
    done[:, 0] = False
    seen[:, medoid] = True
    rows = np.arange(m)
    inside = rows[(own >= 0) & (own != medoid)]
    beam[inside, 1], sims[inside, 1], done[inside, 1] = own[inside], 1.0, False
    seen[inside, own[inside]] = True
    hits_q = [np.flatnonzero(sims[:, 0] >= threshold), inside]
    hits_x = [np.full(len(hits_q[0]), medoid), own[inside]]
    for _ in range(STEPS):
        todo = np.where(done, -3.0, sims)
        pick = todo.argmax(1)
        live = todo[rows, pick] > -2
        if not live.any():
            break
        r = rows[live]
        done[r, pick[live]] = True
        near = graph[beam[r, pick[live]]]
        fresh = ~seen[r[:, None], near]
        seen[r[:, None], near] = True
        s = np.where(fresh, np.einsum("ijd,id->ij", x[near], q[r]), -2.0)
        i, j = np.nonzero(s >= threshold)
        pairs = np.unique(r[i] * n + near[i, j])
        hits_q.append(pairs // n)
        hits_x.append(pairs % n)
        all_s, all_b = np.concatenate([sims[r], s], 1), np.concatenate([beam[r], near], 1)
        all_d = np.concatenate([done[r], ~fresh], 1)
        top = np.argpartition(-all_s, BEAM - 1, axis=1)[:, :BEAM]
        sims[r], beam[r], done[r] = (np.take_along_axis(v, top, 1) for v in (all_s, all_b, all_d))
    fq, fx = np.concatenate(hits_q), np.concatenate(hits_x)
    out_q, out_x = [fq], [fx]
    while len(fq):
        near = graph[fx]
        code = np.unique((fq[:, None] * n + near).ravel())
        a, b = code // n, code % n
        new = ~seen[a, b]
        a, b = a[new], b[new]
        seen[a, b] = True
        good = np.concatenate([np.einsum("id,id->i", q[a[s : s + 100_000]], x[b[s : s + 100_000]]) >= threshold for s in range(0, len(a), 100_000)]) if len(a) else np.zeros(0, bool)
        fq, fx = a[good], b[good]
        out_q.append(fq)
        out_x.append(fx)
    pairs = np.unique(np.concatenate(out_q) * n + np.concatenate(out_x))
    return pairs // n, pairs % n


def nodes_of(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, v): usable vectors as arrays of double."""
    v = F.col(vector).cast("array<double>")
    fine = F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(fine).select(F.col(key).alias("_key"), v.alias("v"))


def _unit(vectors) -> np.ndarray:
    x = np.array(vectors.tolist())
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _reach(nodes: DataFrame, centres: dict[int, np.ndarray], angle: float) -> DataFrame:
    """(shard, n, reach): nodes of each shard, and the largest angle to the centre of those that have no nearer one, up to CLOSE * angle (null: none)."""
    shared = nodes.sparkSession.sparkContext.broadcast(centres)  # CENTRES vectors at most

    def run(frames):
        for f in frames:
            for size, g in f.groupby(f["v"].map(len)):
                sims = _unit(g["v"]) @ shared.value[size].T
                order = np.argsort(-sims, axis=1)[:, :BUILD]
                far = np.arccos(np.clip(np.take_along_axis(sims, order, 1), -1, 1))
                far[(far > CLOSE * angle) | (np.arange(order.shape[1]) > 0)] = -1
                yield pd.DataFrame({"shard": order.ravel() + size * (CENTRES + 1), "far": far.ravel()})

    far = F.when(F.col("far") >= 0, F.col("far"))
    return nodes.mapInPandas(run, "shard long, far double").groupBy("shard").agg(F.count("*"), F.max(far))


def _asked(nodes: DataFrame, centres: dict[int, np.ndarray], floors: dict[int, np.ndarray]) -> DataFrame:
    """(shard, n): nodes that have to be compared with each shard."""
    shared = nodes.sparkSession.sparkContext.broadcast((centres, floors))

    def run(frames):
        c, floor = shared.value
        for f in frames:
            for size, g in f.groupby(f["v"].map(len)):
                n = (_unit(g["v"]) @ c[size].T >= floor[size]).sum(0)
                yield pd.DataFrame({"shard": np.flatnonzero(n) + size * (CENTRES + 1), "n": n[n > 0]})

    return nodes.mapInPandas(run, "shard long, n long").groupBy("shard").agg(F.sum("n"))


def _dealt(nodes: DataFrame, centres: dict[int, np.ndarray], floors: dict[int, np.ndarray], parts: dict, turns: dict, angle: float) -> DataFrame:
    """(shard, part, turn, kind, close, node, copies, v): a row for each node and task in which it takes part.

    kind: 0 at home in the shard, 1 another node of its graph, 2 compared with all of
    it, 3 searches its graph; close: lies within CLOSE * angle of its nearest centre.
    """
    shared = nodes.sparkSession.sparkContext.broadcast((centres, floors, parts, turns))
    names = ["shard", "part", "turn", "kind", "close", "node", "copies", "v"]

    def run(frames):
        c, floor, split, rounds = shared.value
        for f in frames:
            out = []
            for size, g in f.groupby(f["v"].map(len)):
                sims = np.clip(_unit(g["v"]) @ c[size].T, -1, 1)
                order = np.argsort(-sims, axis=1)[:, :PROBE]
                bound = sims >= floor[size]
                near = np.arccos(np.take_along_axis(sims, order[:, :1], 1)[:, 0]) <= CLOSE * angle
                for node, copies, v, close, o, sure in zip(g["node"].tolist(), g["copies"].tolist(), g["v"].tolist(), near.tolist(), order, bound, strict=True):
                    for k, s in enumerate(o[:BUILD].tolist()):
                        shard = s + size * (CENTRES + 1)
                        part = hash(node * 2654435761 % 1000003) % split[shard]
                        out += [(shard, part, u, min(k, 1), close, node, copies, v) for u in range(rounds.get(shard, 1))]
                    for s in {*o.tolist(), *np.flatnonzero(sure).tolist()}:
                        shard = s + size * (CENTRES + 1)
                        turn = hash(node * 40503 % 999983) % rounds.get(shard, 1)
                        out += [(shard, p, turn, 2 if sure[s] else 3, close, node, copies, v) for p in range(split.get(shard, 0))]
                    if len(out) > 20_000:
                        yield pd.DataFrame(out, columns=names)
                        out = []
            yield pd.DataFrame(out, columns=names)

    return nodes.mapInPandas(run, "shard long, part int, turn int, kind int, close boolean, node long, copies long, v array<double>")


class Found:
    """What one task finds, in rows that grow with its nodes, not with its pairs: links that join the same groups, and counts."""

    def __init__(self):
        self.rows: list[np.ndarray] = []

    def add(self, a: np.ndarray, b: np.ndarray | int, n: np.ndarray | int) -> None:
        if len(a):
            self.rows.append(np.column_stack([a, np.broadcast_to(b, len(a)), np.broadcast_to(n, len(a))]).astype(np.int64))

    def frame(self) -> pd.DataFrame:
        return pd.DataFrame(np.concatenate([np.zeros((0, 3), np.int64), *self.rows]), columns=["a", "b", "n"])


def compared(x: np.ndarray, home: pd.DataFrame, asked: pd.DataFrame, threshold: float) -> Found:
    """All links of the asked nodes to the nodes at home, whose unit vectors x has.

    Each link between close nodes is met once from either end.  One to a node that is
    not close is met from that node's end alone if the other one is close, and counts
    for both; links between two that are not close are left to the graphs.
    """
    found, names, copies = Found(), home["node"].to_numpy(), home["copies"].to_numpy()
    close = home["close"].to_numpy()
    group, seen, extra = np.arange(len(x)), np.zeros(len(x), bool), np.zeros(len(x), np.int64)
    for s in range(0, len(asked), 500):
        some = asked.iloc[s : s + 500]
        hit = (_unit(some["v"]) @ x.T >= threshold) & close & (some["node"].to_numpy()[:, None] != names)
        n = hit @ copies
        found.add(some["node"].to_numpy()[n > 0], -1, n[n > 0])
        extra += some["copies"].to_numpy()[~some["close"].to_numpy()] @ hit[~some["close"].to_numpy()]
        first = hit.argmax(1)
        for i in np.flatnonzero(n > 0).tolist():
            at = np.flatnonzero(hit[i])
            seen[at] = True
            own = np.unique(group[at])
            if len(own) > 1:
                group[np.isin(group, own[1:])] = own[0]
        found.add(some["node"].to_numpy()[n > 0], names[first[n > 0]], 0)
    at = np.flatnonzero(seen)
    found.add(names[at], names[group[at]], 0)
    found.add(names[extra > 0], -1, extra[extra > 0])
    return found


def links_of(nodes: DataFrame, threshold: float, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(edges (a, b), counts (node, more)) of nodes (node, copies, v): edges join what links join; more are the rows of other nodes that a node links to."""
    sizes = {r[0]: r[1] for r in nodes.groupBy(F.size("v")).count().collect()}
    centres, floors = {}, {}
    for size, n in sizes.items():
        k = min(CENTRES, max(1, round(n / SHARD * BUILD)))
        chosen = nodes.where(F.size("v") == size).orderBy(F.xxhash64(F.lit("centre"), "v"), "v").limit(k).collect()
        c = np.array([r.v for r in chosen])
        centres[size] = c / np.linalg.norm(c, axis=1, keepdims=True)
        floors[size] = np.full(len(c), 2.0)
    angle = float(np.arccos(np.clip(threshold, -1, 1)))
    parts = {}
    for shard, n, reach in _reach(nodes, centres, angle).collect():  # one row for each centre
        parts[shard] = max(1, -(-n // (2 * SHARD)))
        if reach is not None:
            floors[shard // (CENTRES + 1)][shard % (CENTRES + 1)] = np.cos(min(reach + angle, np.pi)) - 1e-9
    turns = {shard: max(1, -(-n // (2 * SHARD))) for shard, n in _asked(nodes, centres, floors).collect()}

    def graph_rows(f: pd.DataFrame) -> pd.DataFrame:
        """Adjacency lists of one shard, built by its first turn."""
        names = f["node"].to_numpy()
        graph = robust_graph(_unit(f["v"]), threshold) if not f["close"].all() else np.zeros((len(names), 0), np.int64)
        return pd.DataFrame({"node": names, "near": [names[x].tolist() for x in graph]})

    dealt = scratch.keep(_dealt(nodes, centres, floors, parts, turns, angle))
    by = ["shard", "part", "turn"]
    # a node of several shards has the neighbours of all of them; lists are only made where nodes lie far from every centre
    lists = dealt.where("kind < 2 and turn = 0").groupBy("shard", "part").applyInPandas(graph_rows, "node long, near array<long>")
    lists = lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))  # BUILD lists
    lists = scratch.keep(lists)

    def search(f: pd.DataFrame) -> pd.DataFrame:
        home = f[f["kind"] == 0]
        found = Found()
        if len(home):
            found = compared(_unit(home["v"]), home, f[f["kind"] == 2], threshold)
        ask = f[(f["kind"] >= 2) & ~f["close"]]
        members = f[f["kind"] < 2]
        if len(ask) and not members["close"].all():
            names, x = members["node"].to_numpy(), _unit(members["v"])
            graph = neighbours(names, members["near"])
            for s in range(0, len(ask), 2000):
                some = ask.iloc[s : s + 2000]
                q = _unit(some["v"])
                i, j = range_search(x, graph, q, threshold - 1e-9, places(names, some["node"].to_numpy()))
                exact = (np.einsum("id,id->i", q[i], x[j]) >= threshold) & ~members["close"].to_numpy()[j]
                a, b = some["node"].to_numpy()[i[exact]], names[j[exact]]
                found.add(np.minimum(a, b)[a != b], np.maximum(a, b)[a != b], 1)
        return found.frame()

    listed = dealt.where("kind < 2").join(lists, "node", "left").union(dealt.where("kind >= 2").select("node", *(c for c in dealt.columns if c != "node"), F.lit(None).alias("near")))
    rows = scratch.keep(listed.groupBy(*by).applyInPandas(search, "a long, b long, n long"))
    pairs = rows.where("n = 1 and b >= 0").distinct()  # of nodes far from every centre
    edges = rows.where("b >= 0 and a <> b").select("a", "b").distinct()
    both = pairs.select("a", "b").union(pairs.select("b", "a"))
    more = both.join(nodes.select(F.col("node").alias("b"), "copies"), "b").select("a", F.col("copies").alias("n")).union(rows.where("b < 0").select("a", "n"))
    return edges, more.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("more"))


def near_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.9) -> DataFrame:
    """(key, n_links, component_id, kept), one row for each input row; key is an integer column."""
    scratch = Scratch(vectors.sparkSession, "vectors")
    same = nodes_of(vectors, key, vector).groupBy("v").agg(F.count("*").alias("copies"), F.min("_key").alias("low"))
    same = scratch.keep(same.select(F.monotonically_increasing_id().alias("node"), "*"))  # numbered once, as written
    edges, counts = links_of(same.select("node", "copies", "v"), threshold, scratch)
    groups = linked_groups(edges, scratch)
    facts = same.join(groups.withColumnRenamed("id", "node"), "node", "left").join(counts, "node", "left").withColumn("g", F.coalesce("component_id", "node"))
    low = scratch.keep(facts.groupBy("g").agg(F.min("low").alias("_low")))
    facts = facts.join(low, "g").select("v", (F.col("copies") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.col("_low").alias("component_id"))
    rows = vectors.select(F.col(key).alias("_key"), F.col(vector).cast("array<double>").alias("_v")).join(scratch.keep(facts), F.col("_v") == F.col("v"), "left")
    component = F.coalesce("component_id", "_key")
    return rows.select(F.col("_key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.cast("long").alias("component_id"), F.coalesce(F.col("_key") == component, F.lit(False)).alias("kept"))


def recall(vectors: DataFrame, found: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.9, every: int = 100) -> float:
    """Share of the true links of the vectors whose key is divisible by `every` that found.n_links has; brute force in blocks."""
    good = nodes_of(vectors, key, vector)
    true = {}
    asked = good.where(F.col("_key") % every == 0).toLocalIterator()

    def measure(block):
        q, ids = np.array([r.v for r in block]), [r["_key"] for r in block]
        q = q / np.linalg.norm(q, axis=1, keepdims=True)

        def run(frames):
            for f in frames:
                x = np.array(f["v"].tolist())
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                yield pd.DataFrame({"k": ids, "n": (q @ x.T >= threshold).sum(1)})

        for r in good.mapInPandas(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
            true[r.k] = r.n - 1

    block = []
    for r in asked:
        block.append(r)
        if len(block) == 2000:
            measure(block)
            block = []
    if block:
        measure(block)
    got = {r[0]: r[1] for r in found.where(F.col(key) % every == 0).select(key, "n_links").collect()}
    total = sum(true.values())
    return 1.0 if not total else sum(min(got.get(k, 0), n) for k, n in true.items()) / total
