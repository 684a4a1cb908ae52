"""Language of a text by a string kernel.

The kernel of two texts is a blended spectrum of presence kernels: for n = 1..3 the
number of character n-grams that both hold, over the root of the product of their
numbers.  Nystroem landmarks (some documents of each language) span the feature
space; one-versus-rest ridge regression on it is solved on the driver from a
bounded sample.  Since a presence kernel is linear in the indicators of n-grams,
landmarks and weights fold into one matrix (n-grams x languages), and texts are
scored by batched products with it: the same numbers as evaluating the kernel.

N-grams are told apart by a hash into 2**BITS places for each n.

Defined results: a null text, or one without a letter, is `und` with score 0; with
no rows to learn from, everything is; repeated rows give repeated results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled rows fitted on at most, in hash order; landmarks for each language.
FIT_ROWS, LANDMARKS = 3000, 48
ORDERS, BITS, RIDGE = (1, 2, 3), 14, 1e-3
SIZE = len(ORDERS) << BITS
#: Sharpens the regression values (about 0 and 1) before they are normed to sum 1.
SHARP = 8.0


def present(text: str, out: np.ndarray) -> None:
    """Set out[i] to 1 for every n-gram place of the text; case is folded, runs of other signs count as a blank."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    code = np.where((points < 65) | ((points > 90) & (points < 97)) | ((points > 122) & (points < 170)), 32, points).astype(np.uint32)
    code = code[np.append(True, (code[1:] != 32) | (code[:-1] != 32))]  # one blank for each run
    hashed = np.zeros(len(code), np.uint32)
    for k, n in enumerate(ORDERS):
        if len(code) < n:
            break
        hashed = (hashed[: len(code) - n + 1] * np.uint32(0x01000193)) ^ (code[n - 1 :] * np.uint32(0x9E3779B1))
        out[((hashed * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)) + (k << BITS)] = 1


def normed(x: np.ndarray) -> np.ndarray:
    """Indicators with each n's block divided by the root of its count: then K = X Z' / len(ORDERS)."""
    blocks = x.reshape(len(x), len(ORDERS), -1)
    size = np.sqrt(np.maximum(blocks.sum(2, keepdims=True), 1))
    return (blocks / size).reshape(len(x), -1)


def fit(docs: DataFrame, learn=lambda key: F.lit(True), key: str = "doc_id", text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, matrix, intercepts); learn: a column function of the key that tells which rows may be used."""
    usable = docs.where(F.col(key).isNotNull() & F.col(lang).isNotNull() & F.col(text).isNotNull() & learn(F.col(key)))
    ids = usable.select(key).orderBy(F.xxhash64(F.lit("fit"), F.col(key)), key).limit(FIT_ROWS).distinct()
    rows = usable.select(F.col(key), F.col(text), F.col(lang)).join(F.broadcast(ids), key).select(text, lang)

    def vectors(batches):
        for batch in batches:
            out = []
            for t in batch.column(0).to_pylist():
                x = np.zeros(SIZE, np.uint8)
                present(t, x)
                out.append(np.packbits(x).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), batch.column(1)], names=["x", "y"])

    got = sorted((r.y, bytes(r.x)) for r in rows.mapInArrow(vectors, "x binary, y string").collect())  # FIT_ROWS rows of 6 KB
    names = sorted({y for y, _ in got})
    if not names:
        return [], np.zeros((SIZE, 0)), np.zeros(0)
    packed = np.frombuffer(b"".join(v for _, v in got), np.uint8).reshape(len(got), -1)

    def unpacked(at) -> np.ndarray:
        return normed(np.unpackbits(packed[at], axis=1).astype(np.float32))

    y = np.array([y for y, _ in got])
    marks = np.concatenate([np.flatnonzero(y == n)[np.linspace(0, (y == n).sum() - 1, min(LANDMARKS, (y == n).sum())).astype(int)] for n in names])
    z = unpacked(marks)
    value, vector = np.linalg.eigh((z @ z.T / len(ORDERS)).astype(np.float64))
    keep = value > 1e-8 * value[-1]
    root = vector[:, keep] / np.sqrt(value[keep])  # features = K(x, landmarks) @ root
    # the rows stay packed but for 128 at a time
    phi = np.concatenate([(unpacked(slice(i, i + 128)) @ z.T / len(ORDERS)).astype(np.float64) @ root for i in range(0, len(packed), 128)])
    mean = phi.mean(0)
    target = (y[:, None] == np.array(names)).astype(np.float64)
    centred = phi - mean
    w = np.linalg.solve(centred.T @ centred + RIDGE * len(y) * np.eye(phi.shape[1]), centred.T @ (target - target.mean(0)))
    return names, (z.T.astype(np.float64) @ (root @ w) / len(ORDERS)).astype(np.float32), target.mean(0) - mean @ w


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], text: str = "text") -> DataFrame:
    """docs with lang_pred (string) and score (double); columns of these names are replaced."""
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    schema = StructType([*(docs.schema[c] for c in kept), StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one number for each n-gram place and language

    def run(batches):
        names, matrix, base = shared.value
        for whole in batches:
            for start in range(0, whole.num_rows, 64):
                batch = whole.slice(start, 64)
                texts = batch.column(text).to_pylist()
                x = np.zeros((len(texts), SIZE), np.float32)
                told = np.zeros(len(texts), bool)
                for i, t in enumerate(texts):
                    if t and names and any(map(str.isalpha, t)):
                        told[i] = True
                        present(t, x[i])
                pred, score = ["und"] * len(texts), np.zeros(len(texts))
                if told.any():
                    raw = normed(x[told]) @ matrix + base
                    p = np.exp(SHARP * (raw - raw.max(1, keepdims=True)))
                    p /= p.sum(1, keepdims=True)
                    for i, k, s in zip(np.flatnonzero(told), p.argmax(1), p.max(1), strict=True):
                        pred[i], score[i] = names[k], float(s)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred), pa.array(score, pa.float64())], names=[*kept, "lang_pred", "score"])

    return docs.select(*kept).mapInArrow(run, schema)
