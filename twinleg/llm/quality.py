"""Quality classifier: learned hashed subword vectors, averaged per document, with a softmax output.

Features are hashed words and character n-grams.  Training is mini-batch stochastic gradient descent in numpy, in one task over
a bounded sample of labelled rows.  For scoring, vectors and output weights are folded into one number per bucket: the output is
linear in the mean vector, so the mean of these numbers is the same log-odds.
"""

from __future__ import annotations

from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import mixed
from .common import bounded_batches, schema_with

#: Buckets of the hash, size of a vector, character n-gram lengths, and the bound on labelled rows used for training.
BUCKETS, DIM, GRAMS, SAMPLE_ROWS = 1 << 15, 8, (2, 4), 6000
EPOCHS, BATCH, RATE = 6, 64, 0.5
#: Bytes of text whose features are made at once; these take about 120 bytes for each.
CHUNK = 1 << 18

_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def features(texts: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every feature of every text, and their number per text: byte n-grams and words of " text "."""
    raw = [b" " + t.encode() + b" " for t in texts]
    size = np.array([len(r) for r in raw])
    data = np.frombuffer(b"".join(raw), np.uint8)
    owner = np.repeat(np.arange(len(raw)), size)
    value, shift = _BYTE[data], np.uint64(64 - buckets.bit_length() + 1)
    found, whose = [], []
    for n in GRAMS:
        if len(data) < n:
            continue
        h = np.zeros(len(data) - n + 1, np.uint64)
        for k in range(n):
            h = h * np.uint64(0xD1342543DE82EF95) + value[k : len(data) - n + 1 + k]
        inside = owner[: len(h)] == owner[n - 1 :]
        found.append(((h * np.uint64(0x9E3779B97F4A7C15 + 2 * n)) >> shift).astype(np.int64)[inside])
        whose.append(owner[: len(h)][inside])
    space = _SPACE[data]
    begin, end = np.flatnonzero(space[:-1] & ~space[1:]) + 1, np.flatnonzero(~space[:-1] & space[1:]) + 1
    if len(begin):
        total = np.r_[np.uint64(0), np.cumsum(value * (value >> np.uint64(7)))]
        h = (total[end] - total[begin]) ^ (value[begin] << np.uint64(1)) ^ (value[end - 1] << np.uint64(2))
        found.append((mixed(h) >> shift).astype(np.int64))
        whose.append(owner[begin])
    flat, whose = np.concatenate(found), np.concatenate(whose)
    order = np.argsort(whose, kind="stable")
    return flat[order], np.bincount(whose, minlength=len(raw))


def fit_numpy(texts: list[str], labels: np.ndarray, seed: int = 7) -> np.ndarray:
    """Train vectors and a softmax over two classes; return the log-odds of class 1 per bucket, then the bias."""
    rng = np.random.default_rng(seed)
    table, out, bias = rng.normal(0, 0.1, (BUCKETS, DIM)), rng.normal(0, 0.1, (DIM, 2)), np.zeros(2)
    # of all documents in a row: different buckets and their counts, packed, as they are held through all epochs
    packed, counts, ends = array("H"), array("I"), [0]
    for t in texts:
        at, count = np.unique(features([t])[0], return_counts=True)
        packed.frombytes(at.astype(np.uint16).tobytes())
        counts.frombytes(count.astype(np.uint32).tobytes())
        ends.append(len(packed))
    packed, counts = np.frombuffer(packed, np.uint16), np.frombuffer(counts, np.uint32)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        order = rng.permutation(len(texts))
        for i in range(0, len(order), BATCH):
            part = order[i : i + BATCH]
            bags = [slice(ends[j], ends[j + 1]) for j in part]
            at = np.concatenate([packed[s] for s in bags]).astype(np.int64)
            share = np.concatenate([counts[s] / counts[s].sum() for s in bags])
            row = np.repeat(np.arange(len(part)), [s.stop - s.start for s in bags])
            begin = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            mean = np.add.reduceat(table[at] * share[:, None], begin)
            z = mean @ out + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(part)), labels[part]] -= 1
            back = p @ out.T
            out -= rate * mean.T @ p / len(part) * 4
            bias -= rate * p.mean(0)
            # a step of one example per document, scaled up for the small share of each bucket
            step = rate * 2 * np.sqrt(len(share) / len(part)) * share
            for d in range(DIM):
                table[:, d] -= np.bincount(at, step * back[row, d], BUCKETS)
    odds = table @ (out[:, 1] - out[:, 0])
    return np.r_[odds, bias[1] - bias[0]]


def held_out(doc_id: str = "doc_id"):
    """Whether crc32 of the id as text is divisible by 5; a null id counts as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Fit on at most ``sample_rows`` labelled documents that are not held out: those of smallest hashed id.

    Null labels and ids are left out; of labels that contradict, the smaller holds.  Without rows of both classes all weights
    are zero and the bias carries the class that is there.
    """
    labels = labels.where("doc_id is not null and quality in (0, 1)").where(~held_out()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
    # the sample's ids first: a bounded top-n, so that texts are read once against a small bounded side
    chosen = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "text"]).drop_duplicates("doc_id")
        y = pdf["label"].to_numpy()
        if len(set(y.tolist())) < 2:
            weights = np.zeros(BUCKETS + 1)
            weights[-1] = 2.0 * (y.mean() * 2 - 1)
        else:
            weights = fit_numpy(pdf["text"].tolist(), y)
        return pd.DataFrame({"weights": [weights.astype("<f4").tobytes()]})

    made = rows.groupBy().applyInPandas(run, "weights binary").first()
    return np.frombuffer(bytes(made[0]), "<f4") if made else np.zeros(BUCKETS + 1, np.float32)


def score(docs: DataFrame, weights: np.ndarray, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """Add score (probability of class 1) and predicted (1 where it reaches ``threshold``) to every row.

    Null and empty texts get the score of a text without words.  Columns of these names are replaced; no rows give no rows.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.drop("score", "predicted")
    schema = schema_with(docs, score="double", predicted="int")
    weights = np.asarray(weights, np.float32)

    def run(batches):
        for b in batches:
            texts = b.column(b.schema.get_field_index(text))
            size = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
            odds, i = [], 0
            while i < len(size):
                j, total = i, 0
                while j < len(size) and (j == i or total + size[j] < CHUNK):
                    total += size[j]
                    j += 1
                # only a chunk's texts are Python strings at a time
                at, count = features([t or "" for t in texts.slice(i, j - i).to_pylist()])
                odds.append(np.add.reduceat(weights[at].astype(np.float64), np.cumsum(count) - count) / count)
                i = j
            p = 1 / (1 + np.exp(-(np.concatenate(odds) if odds else np.empty(0)) - float(weights[-1])))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=[*b.schema.names, "score", "predicted"])

    return docs.mapInArrow(run, schema)
