"""Hard-negative mining by a secondary-sort shuffle.

Anchors meet rows in blocks of bounded size.  A first pass keeps each block's best positives of an anchor, so that the second
knows the anchor's windows and gives only rows that can fall into one of them.  Those scores are packed into keys of anchor,
descending score and id; ``repartitionAndSortWithinPartitions`` deals them by anchor, and one pass over each sorted partition
opens a window at every positive and emits the negatives that fall into it.  No anchor's rows are ever held.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small, written

#: Positives of an anchor, negatives of a positive, and a negative's score in hundredths of the positive's: least, most.
POSITIVES, NEGATIVES, LEAST, MOST = 5, 10, 30, 90
#: Rows of a block, anchors of a block, and anchors scored at once.
ROWS, ANCHORS, AT_ONCE = 32_768, 32_768, 64
#: Components below this give sums that a double holds exactly, up to 512 of them.
EXACT = 1 << 22
LONG = (1 << 63) - 1
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def whole(x: float) -> int:
    """floor(256 * x), exact for every finite double."""
    return int(x) * 256 if abs(x) >= 2.0**44 else int(np.floor(256.0 * x))


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole-number rows as 64-bit integers, exact; those beyond a long stay at its ends."""
    big_a, big_b = (np.abs(m).max(1, initial=0) >= EXACT for m in (a, b))
    out = np.zeros((len(a), len(b)), np.int64)
    if a.shape[1] <= 512 and not big_a.any() and not big_b.any():
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    whole_a, whole_b = ([[int(v) for v in row] for row in m] for m in (a, b))
    for i, p in enumerate(whole_a):
        for j, q in enumerate(whole_b):
            out[i, j] = max(-LONG, min(LONG, sum(x * y for x, y in zip(p, q, strict=True))))
    return out


def pack(anchor: int, anchor_row: int, score: int, other: int, other_row: int) -> bytes:
    """A key whose byte order is anchor, descending score, id."""
    return struct.pack(">QQQQQ", anchor + (1 << 63), anchor_row, LONG - score, other + (1 << 63), other_row)


def unpack(key: bytes) -> tuple[int, int, int, int, int]:
    a, row, s, b, other = struct.unpack(">QQQQQ", key)
    return a - (1 << 63), row, LONG - s, b - (1 << 63), other


def mined(pairs: Iterator[tuple[bytes, bool]], positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST):
    """Rows of the result from one partition's sorted (key, whether the labels are equal).

    Only the open windows of the current anchor and its first negatives of score zero are held: a negative of a positive with
    score zero has that score too, and may come before it.
    """
    current, windows, zeros = None, [], []
    for key, same in pairs:
        if key[:16] != current:
            current, windows, zeros = key[:16], [], []
        anchor, _, score, other, _ = unpack(key)
        if same:
            if len(windows) < positives:
                windows.append([other, score, 0])
                for n in zeros if score == 0 else ():
                    windows[-1][2] += 1
                    yield anchor, other, windows[-1][2], n, 0, 0
            continue
        if score == 0 and len(zeros) < negatives:
            zeros.append(other)
        for w in windows:
            if w[2] < negatives and least * w[1] <= 100 * score <= most * w[1]:
                w[2] += 1
                yield anchor, w[0], w[2], other, w[1], score


def _unpacked(column: pd.Series, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<i8").reshape(-1, dim)


def _prepared(vectors: DataFrame, anchors: Column, label: Column) -> DataFrame:
    """Rows that take part: row, vec_id, label, anchor, dim, v (whole-number components as bytes); a written table."""
    e = F.col("embedding").cast("array<double>")
    good = "vec_id is not null and label is not null and e is not null and size(e) > 0 and forall(e, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("string").alias("label"), F.coalesce(anchors, F.lit(False)).alias("anchor"), e.alias("e"))
    rows = rows.where(good).withColumn("row", F.monotonically_increasing_id())

    def packed(batches):
        for b in batches:
            e = b.column("e")
            flat, size = e.flatten().to_numpy(zero_copy_only=False), np.diff(e.offsets.to_numpy())
            v = np.floor(256.0 * np.clip(flat, -(2.0**40), 2.0**40)).astype(np.int64)
            for i in np.flatnonzero(np.abs(flat) > 2.0**40):
                v[i] = max(-LONG, min(LONG, whole(float(flat[i]))))
            ends = np.cumsum(size)
            out = [v[z - n : z].astype("<i8").tobytes() for z, n in zip(ends.tolist(), size.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("vec_id"), b.column("label"), b.column("anchor"), pa.array(size.astype(np.int32)), pa.array(out, pa.binary())], names=["row", "vec_id", "label", "anchor", "dim", "v"])

    return written(rows.mapInArrow(packed, "row long, vec_id long, label string, anchor boolean, dim int, v binary"), "negatives")


def _meet(rows: DataFrame, anchors: DataFrame, task, schema: str) -> DataFrame:
    """``task`` on every block of anchors with every block of rows of the same dimension."""
    n, m = rows.count() // ROWS + 1, anchors.count() // ANCHORS + 1
    deal = lambda k, salt: F.expr(f"int(pmod(xxhash64(row, {salt}), {k}))")
    left = anchors.withColumn("x", deal(m, 1)).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    right = rows.withColumn("y", deal(n, 2)).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    left = left.select(*(F.col(c).alias(c, metadata={"side": "anchor"}) for c in left.columns))  # columns of its own: both sides come of one table
    return left.groupBy("x", "y", "dim").cogroup(right.groupBy("x", "y", "dim")).applyInPandas(task, schema)


def hard_negatives(vectors: DataFrame, anchors: Column, label: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for each row of ``vectors`` (vec_id, embedding,
    label) where ``anchors`` holds; ``label`` is taken instead of the column label.

    A component x becomes floor(256 * x); a score is the integer inner product, held at the ends of a long beyond them.  Order is
    descending score, then vec_id.  An anchor's positives are its first ``positives`` other rows of the same label; a positive's
    negatives are the first ``negatives`` rows of another label with least * p <= 100 * n <= most * p.  Rows without vec_id, label
    or vector, with an empty vector or with null or non-finite components take no part; vectors of different length never meet.
    Rows that repeat a vec_id are rows of their own, and so are anchors.  Other columns are left out; no rows give no rows.

    Every anchor meets every row once in each of two passes (the work grows with anchors times rows), and each (anchor, block of
    ROWS rows) sends at most ``positives`` * (1 + ``negatives``) keys into the shuffle.
    """
    spark: SparkSession = vectors.sparkSession
    rows = _prepared(vectors, anchors, F.col("label") if label is None else label)
    seeds = rows.where("anchor")

    def parts(left: pd.DataFrame, right: pd.DataFrame):
        """Per chunk of anchors: chunk, row order by vec_id, scores (own row left out of positives), whether labels are equal."""
        right = right.sort_values(["vec_id", "row"], kind="stable")
        dim = int(right["dim"].iat[0])
        b, ids, own = _unpacked(right["v"], dim), right["vec_id"].to_numpy(), right["row"].to_numpy()
        names, code = np.unique(np.r_[left["label"].to_numpy(str), right["label"].to_numpy(str)], return_inverse=True)
        for i in range(0, len(left), AT_ONCE):
            part = left.iloc[i : i + AT_ONCE]
            s = scores(_unpacked(part["v"], dim), b)
            yield part, ids, own, s, code[i : i + len(part), None] == code[None, len(left) :]

    def best_positives(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            for part, ids, own, s, same in parts(left, right):
                for k, (a, a_row) in enumerate(zip(part["vec_id"], part["row"], strict=True)):
                    at = np.flatnonzero(same[k] & (own != a_row))
                    if len(at) > positives:  # all that reach the score of the last one kept, then by score and id
                        at = at[s[k, at] >= np.partition(s[k, at], len(at) - positives)[len(at) - positives]]
                    at = at[np.argsort(-s[k, at], kind="stable")[:positives]]
                    out += [(a, a_row, int(s[k, j]), int(ids[j]), int(own[j])) for j in at]
        return pd.DataFrame(out, columns=["a", "a_row", "score", "id", "id_row"]).astype("int64")

    found = written(_meet(rows, seeds, best_positives, "a long, a_row long, score long, id long, id_row long"), "positives")
    # at most ``positives`` from each block of rows
    ranked = F.expr(f"slice(array_sort(collect_list(named_struct('s', -score, 'id', id, 'r', id_row))), 1, {positives})")
    windows = written(found.groupBy("a", F.col("a_row").alias("row")).agg(ranked.alias("best")), "windows")
    opened = windows.select("row", F.expr("transform(best, x -> -x.s)").alias("p"))
    ready = seeds.join(small(opened), "row")

    def fitting(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            for part, ids, own, s, same in parts(left, right):
                for k, (a, a_row, best) in enumerate(zip(part["vec_id"], part["row"], part["p"], strict=True)):
                    bounds = {(-(-least * p // 100), most * p // 100) for p in (int(p) for p in best)}
                    keep = set()
                    for lo, hi in bounds:
                        at = np.flatnonzero(~same[k] & (s[k] >= lo) & (s[k] <= hi)) if lo <= hi else ()
                        if len(at) > negatives:
                            at = at[s[k, at] >= np.partition(s[k, at], len(at) - negatives)[len(at) - negatives]]
                            at = at[np.argsort(-s[k, at], kind="stable")[:negatives]]
                        keep.update(at)
                    out += [pack(int(a), int(a_row), int(s[k, j]), int(ids[j]), int(own[j])) for j in keep]
        return pd.DataFrame({"key": out})

    negative = _meet(rows, ready, fitting, "key binary").withColumn("same", F.lit(False))
    opening = windows.select("a", "row", F.explode("best").alias("b")).select("a", "row", (-F.col("b.s")).alias("s"), "b.id", "b.r")
    pairs = negative.rdd.map(lambda r: (bytes(r[0]), r[1])).union(opening.rdd.map(lambda r: (pack(*r), True)))
    dealt = pairs.repartitionAndSortWithinPartitions(int(spark.conf.get("spark.sql.shuffle.partitions")), lambda key: zlib.crc32(key[:16]))
    return spark.createDataFrame(dealt.mapPartitions(lambda part: mined(part, positives, negatives, least, most)), RESULT, verifySchema=False)
