"""Byte-level BPE encoding and decoding, exact and in linear time.

The vocabulary lies in pyahocorasick's trie (bytes mapped to Latin-1 characters,
because it takes str), which tells how far any entry can reach from a start.  The
encoder takes the longest match there, backs off to shorter ones and steps back
when a position turns out to be a dead end; two neighbouring tokens are accepted
only if BPE itself would leave that pair unmerged.  That test is memoised, and
dead ends are marked, so each position is settled once.  (The trie is asked only
at starts the walk visits; scanning every piece for all entries took twice as long.)

Defined results: a null or empty text has no tokens; lone carriage returns, NULs
and any other character are ordinary bytes; duplicate rows yield duplicate rows; a
column that has the name of the added one is replaced by it.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import tidy

#: Entries of a task's table of encoded pre-tokens; it is emptied when full and at the task's end.
MEMO_ENTRIES = 400_000
#: Longer parts are not kept in that table.
MEMO_CHARS = 48
#: The usual pattern of byte-level vocabularies (a fixed value): only here texts are cut at spaces first.
SPACED_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

inner_space = re.compile(r"\s \s|\s \Z").search


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}


class BytePairCodec:
    """Encoder and decoder for one rank file (token bytes -> rank; rank is the id)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        self.find = regex.compile(pattern).findall
        self.ids = {t.decode("latin-1"): i for t, i in ranks.items()}
        self.text = {i: t for t, i in self.ids.items()}
        self.bytes = {i: t for t, i in ranks.items()}
        self.trie = ahocorasick.Automaton()
        for t, i in self.ids.items():
            self.trie.add_word(t, i)
        self.halves: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.compatible: dict[tuple[int, int], bool] = {}
        for i in sorted(self.text):
            self._find_halves(i)
        self.compatible.clear()  # judged while the merge table was incomplete
        #: Entries that merges can make; the others stand only for a whole pre-token.
        self.live = {t: i for t, i in self.ids.items() if len(t) == 1 or self.halves[i] != (i, i)}
        self.longest = max(map(len, self.ids), default=0)
        self.tails: dict[str, tuple[int, ...]] = {}
        self.memo: dict[str, tuple[str, tuple[int, ...]]] = {}
        self.spaced = pattern == SPACED_PATTERN

    def _find_halves(self, i: int) -> None:
        """The two tokens whose merge makes token i; a token no merge makes is its own half."""
        t = self.text[i]
        for cut in range(len(t) - 1, 0, -1):
            a, b = self.ids.get(t[:cut]), self.ids.get(t[cut:])
            if a is not None and b is not None and a < i and b < i and self._judge(a, b):
                self.halves[i] = (a, b)
                self.merged[a, b] = i
                return
        self.halves[i] = (i, i)

    def _judge(self, a: int, b: int) -> bool:
        """Would BPE, run over the bytes of a and b together, end with exactly a, b?

        Undo the younger of the two merges at the border again and again: if the
        facing parts could have merged earlier than that, they would have.
        """
        before = float("inf")
        while True:
            joined = self.merged.get((a, b))
            if joined is not None and joined < before:
                return False
            inner_a, inner_b = self.halves[a][1], self.halves[b][0]
            if inner_a == a and inner_b == b:
                return True
            if inner_b == b or (a > b and inner_a != a):
                before, a = a, inner_a
            else:
                before, b = b + 1, inner_b

    def fits(self, a: int, b: int) -> bool:
        known = self.compatible.get((a, b))
        if known is None:
            if len(self.compatible) >= 4 * MEMO_ENTRIES:
                self.compatible.clear()
            known = self.compatible[a, b] = self._judge(a, b)
        return known

    def merge(self, piece: str) -> list[int]:
        """Token ids of one pre-token, given as Latin-1 characters."""
        whole = self.ids.get(piece)
        if whole is not None:
            return [whole]
        return self.walk(piece) if len(piece) > MEMO_CHARS else list(self.tail(piece))

    def tail(self, piece: str) -> tuple[int, ...]:
        """merge() of a short string by its first token and the known tokens of the rest.

        A row of tokens is what BPE makes exactly if all its neighbours fit, so a
        first token that fits the rest's first token completes the row.
        """
        known = self.tails.get(piece)
        if known is not None:
            return known
        get, size = self.live.get, self.trie.longest_prefix(piece)
        if size == len(piece) and (token := get(piece)) is not None:
            return (token,)
        while size:
            if (token := get(piece[:size])) is not None and size < len(piece):
                rest = self.tails.get(piece[size:]) or self.tail(piece[size:])
                if ((token, rest[0]) in self.compatible and self.compatible[token, rest[0]]) or self.fits(token, rest[0]):
                    if len(self.tails) >= MEMO_ENTRIES:
                        self.tails.clear()
                    self.tails[piece] = known = (token, *rest)
                    return known
            size -= 1
        raise ValueError("the vocabulary cannot spell these bytes")

    def walk(self, piece: str) -> list[int]:
        """merge() of a long string, without recursion."""
        n = len(piece)
        get, fits, reach = self.live.get, self.fits, self.trie.longest_prefix
        out: list[int] = []
        starts: list[int] = []
        bound = [-1] * (n + 1)  # the longest match not yet tried at each start; -1: not looked up
        dead = bytearray(n + 1)
        pos, last = 0, -1
        while pos < n:
            size = bound[pos]
            if size < 0:
                size = reach(piece[pos : pos + self.longest])  # no more than an entry can hold, so each start costs the same
            while size:
                end = pos + size
                size -= 1
                if not dead[end] and (token := get(piece[pos:end])) is not None and (last < 0 or fits(last, token)):
                    bound[pos] = size
                    out.append(token)
                    starts.append(pos)
                    pos, last = end, token
                    bound[pos] = -1
                    break
            else:
                dead[pos] = 1
                if not out:
                    raise ValueError("the vocabulary cannot spell these bytes")
                out.pop()
                pos, last = starts.pop(), out[-1] if out else -1
        return out

    def chunks(self, text: str) -> list[str]:
        """text cut so that each part can be split into pre-tokens on its own.

        A pre-token holds a space only at its head or inside a run of white
        space, so every space may start a part, unless it stands between two
        white-space characters or, after one, at the end; such rare texts stay whole.
        """
        if not self.spaced or " " not in text or inner_space(text):
            return [text]
        first, *rest = text.split(" ")
        return [first, *map(" ".__add__, rest)] if first else list(map(" ".__add__, rest))

    def encode(self, text: str) -> list[int]:
        memo, code = self.memo, self.code
        return [i for x in self.chunks(text) for i in (memo.get(x) or code(x))[1]]

    def code(self, chunk: str) -> tuple[str, tuple[int, ...]]:
        """(ids joined by commas, ids) of a part of a text; short parts go to the bounded table."""
        ids: list[int] = []
        for piece in self.find(chunk):
            ids += self.merge(piece if piece.isascii() else piece.encode().decode("latin-1"))
        made = ",".join(map(str, ids)), tuple(ids)
        if len(chunk) <= MEMO_CHARS:
            if len(self.memo) >= MEMO_ENTRIES:
                self.memo.clear()
            self.memo[chunk] = made
        return made

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def forget(self) -> None:
        """Empty the tables that only save time: some 180 MB when full, and filled again within a small part of a task."""
        for table in (self.memo, self.tails, self.compatible):
            table.clear()


_codecs: dict[tuple[str, str], BytePairCodec] = {}


def codec(path: str, pattern: str) -> BytePairCodec:
    """One codec per Python worker and vocabulary."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = BytePairCodec(load_ranks(path), pattern)
        gc.freeze()  # the tables hold no cycles; walking them again and again takes a third of the time
        gc.set_threshold(200_000, 50, 100)
    return _codecs[path, pattern]


def _coded(run, path: str, pattern: str):
    """run(codec, batches) as a function of batches that leaves no filled tables in the worker."""

    @tidy
    def coded(batches):
        c = codec(path, pattern)
        try:
            yield from run(c, batches)
        finally:
            c.forget()

    return coded


def _slices(batch: pa.RecordBatch, rows: int = 512):
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def encode_column(docs: DataFrame, path: str, pattern: str, text: str = "text", into: str = "token_ids") -> DataFrame:
    """docs with one more column: the token ids (array<int>) of the whole text; null and empty give []."""
    from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

    kept = [c for c in docs.columns if c != into]
    schema = StructType([*(docs.schema[c] for c in kept), StructField(into, ArrayType(IntegerType()))])

    def run(c, batches):
        for whole in batches:
            for batch in _slices(whole):
                ids = [c.encode(t) if t else [] for t in batch.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(ids, pa.list_(pa.int32()))], names=[*kept, into])

    return docs.select(F.col(text).alias("_read"), *kept).mapInArrow(_coded(run, path, pattern), schema)


def decode_column(docs: DataFrame, path: str, pattern: str, ids: str = "token_ids", into: str = "decoded") -> DataFrame:
    """docs with one more column: the bytes (binary) that the ids stand for; null ids give empty bytes."""
    from pyspark.sql.types import BinaryType, StructField, StructType

    kept = [c for c in docs.columns if c != into]
    schema = StructType([*(docs.schema[c] for c in kept), StructField(into, BinaryType())])

    def run(c, batches):
        for whole in batches:
            for batch in _slices(whole):
                back = [c.decode(x or ()) for x in batch.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(back, pa.binary())], names=[*kept, into])

    return docs.select(F.col(ids).alias("_read"), *kept).mapInArrow(_coded(run, path, pattern), schema)


def round_trip(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256: encode, decode and digest in one pass, nothing is shuffled.

    ids_sha256 is over the decimal ids joined by commas, decoded_sha256 over the
    bytes that decoding those ids gives.
    """

    def run(c, batches):
        memo, code, chunks, token = c.memo, c.code, c.chunks, c.bytes.__getitem__
        sha = hashlib.sha256
        for whole in batches:
            for batch in _slices(whole):
                n, a, b = [], [], []
                for t in batch.column(1).to_pylist():
                    coded = [memo.get(x) or code(x) for x in chunks(t)] if t else []
                    ids = [i for _, x in coded for i in x]
                    n.append(len(ids))
                    a.append(sha(",".join([x for x, _ in coded if x]).encode()).hexdigest())
                    b.append(sha(b"".join(map(token, ids))).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key), F.col(text).cast("string").alias("_text"))
    return rows.mapInArrow(_coded(run, path, pattern), f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
