"""Benchmark decontamination: n-gram seeds, then local alignment.

Every n-gram of a test item is a seed: one that is rare in the corpus may just be
one that edits broke, so none is left out for its frequency.  Documents that hold a
seed are aligned with the item around it (Smith-Waterman over words, linear gaps),
as far out as gaps can reach without losing min_share, so edited and paraphrased
copies score as well.  A pair counts as leaked if the score reaches min_share of
the score of a full copy.  A copy that keeps no NGRAM words in a row, such as one
with a word put in after every second one, holds no seed.

Test items are taken in blocks of at most BLOCK_ITEMS and BLOCK_BYTES, so what is
broadcast is bounded; every block meets all documents.

Defined results: null and empty documents or items match nothing; items shorter
than one n-gram use their whole sequence; repeated rows give repeated pairs.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NGRAM, BLOCK_ITEMS, BLOCK_BYTES = 3, 20_000, 16 << 20
MATCH, MISMATCH, GAP = 2, -1, -1
MIN_SHARE = 0.55

words = re.compile(r"\w+").findall


class Items:
    """Word ids and n-grams of one block of test items."""

    def __init__(self, items: list[tuple[object, str]]):
        self.vocabulary: dict[str, int] = {}
        self.rows: list[tuple[object, np.ndarray]] = []
        for key, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words((text or "").lower())]
            if ids:
                self.rows.append((key, np.array(ids, np.int64)))
        self.base = len(self.vocabulary) + 1
        self.short = [(key, ids) for key, ids in self.rows if len(ids) < NGRAM]
        self.grams: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, (_, ids) in enumerate(self.rows):
            for i, code in enumerate(self.codes(ids)):
                self.grams[int(code)].append((k, i))
        self.known = np.array(sorted(self.grams), np.int64)

    def codes(self, ids: np.ndarray) -> np.ndarray:
        """A number for every n-gram; 0 if one of its words is in no item."""
        n = NGRAM
        if len(ids) < n:
            return np.zeros(0, np.int64)
        out, ok = np.zeros(len(ids) - n + 1, np.uint64), np.ones(len(ids) - n + 1, bool)
        for k in range(n):
            part = ids[k : len(ids) - n + 1 + k]
            out = out * np.uint64(0x9E3779B97F4A7C15 if self.base > 2_000_000 else self.base) + part.astype(np.uint64)
            ok &= part > 0
        return np.where(ok, out.view(np.int64), 0)

    def document(self, text: str | None) -> np.ndarray:
        get = self.vocabulary.get
        return np.array([get(w, 0) for w in words((text or "").lower())], np.int64)

    def hits(self, ids: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, codes) of the n-grams that are in the sorted array known."""
        codes = self.codes(ids)
        at = np.flatnonzero(codes)
        if not len(at) or not len(known):
            return at[:0], codes[:0]
        found = codes[at]
        place = np.minimum(np.searchsorted(known, found), len(known) - 1)
        good = known[place] == found
        return at[good], found[good]


def smith_waterman(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """(best local score, position in text after its last word)."""
    n = len(text)
    slope = np.arange(n + 1) * -GAP
    above, best, end = np.zeros(n + 1, np.int64), 0, 0
    for w in item:
        row = np.zeros(n + 1, np.int64)
        row[1:] = above[:-1] + np.where(text == w, MATCH, MISMATCH)
        row = np.maximum(np.maximum(row, above + GAP), 0)
        above = np.maximum.accumulate(row + slope) - slope
        if (top := int(above.max())) > best:
            best, end = top, int(above.argmax())
    return best, end


def _blocks(benchmark: DataFrame, key: str, text: str):
    block, size = [], 0
    for r in benchmark.select(key, text).where(F.col(text).isNotNull()).orderBy(key, text).toLocalIterator():
        block.append((r[0], r[1]))
        size += len(r[1])
        if len(block) >= BLOCK_ITEMS or size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", min_share: float = MIN_SHARE) -> DataFrame:
    """(key, item_key, share, first_word, last_word): the passages aligned with a test item, the best one for each pair of rows."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    source = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    kind, item_kind = docs.schema[key].dataType.simpleString(), benchmark.schema[item_key].dataType.simpleString()
    schema = f"`{key}` {kind}, `{item_key}` {item_kind}, share double, first_word int, last_word int"
    item_type = to_arrow_type(benchmark.schema[item_key].dataType)
    made = None
    for block in _blocks(benchmark, item_key, item_text):
        shared = spark.sparkContext.broadcast(items := Items(block))

        def align(batches, shared=shared):
            items = shared.value
            for batch in batches:
                out = []
                for doc, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if not t:
                        continue
                    ids = items.document(t)
                    out += ((doc, *x) for x in _aligned(items, ids, min_share))
                columns = list(zip(*out, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.column(0).type), pa.array(columns[1], item_type), pa.array(columns[2], pa.float64()), pa.array(columns[3], pa.int32()), pa.array(columns[4], pa.int32())], names=[key, item_key, "share", "first_word", "last_word"])

        part = source.mapInArrow(align, schema)
        made = part if made is None else made.union(part)
    return made if made is not None else spark.createDataFrame([], schema)


def _aligned(items: Items, ids: np.ndarray, min_share: float):
    """(item key, share, first word, last word) for every item that a document leaks."""
    at, codes = items.hits(ids, items.known)
    spans: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for pos, code in zip(at.tolist(), codes.tolist(), strict=True):
        for k, i in items.grams[code]:
            size = len(items.rows[k][1])
            pad = int(size * (1 - min_share) * MATCH / -GAP) + 2
            spans[k].append((max(0, pos - i - pad), min(len(ids), pos - i + size + pad)))
    for k, wide in spans.items():
        item_key, item = items.rows[k]
        best = None
        wide.sort()
        a, b = wide[0]
        for x, y in [*wide[1:], (1 << 60, 1 << 60)]:
            if x <= b and y - a <= 8 * len(item) + 64:
                b = max(b, y)
                continue
            # no score without matches: each takes another word of the item and of the text
            if np.isin(ids[a:b], item).sum() >= min_share * len(item) - 1e-9:
                score, end = smith_waterman(item, ids[a:b])
                share = score / (MATCH * len(item))
                if share >= min_share and (best is None or share > best[1]):
                    best = item_key, share, a, a + end
            a, b = x, y
        if best:
            key_, share, a, end = best
            _, back = smith_waterman(item[::-1], ids[a:end][::-1])
            yield key_, share, end - back, end - 1
    # items too short for an n-gram: their whole sequence
    for item_key, item in items.short:
        run = np.flatnonzero(np.all([ids[i : len(ids) - len(item) + 1 + i] == w for i, w in enumerate(item)], axis=0)) if len(ids) >= len(item) else []
        if len(run):
            yield item_key, 1.0, int(run[0]), int(run[0]) + len(item) - 1
