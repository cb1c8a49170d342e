"""Embedding near-duplicates by collision counting on one-dimensional projections.

Vectors of a label are dealt into slabs of bounded size, and every two slabs of a label meet in one task.  There unit vectors
are projected on fixed random directions, every projection is sorted, a window centred on each query gives its collisions, and
pairs whose collisions reach the calibrated count are verified by their exact cosine.  Equal vectors are one row with a weight,
so copies are not expanded; a task returns counts and spanning links, not all pairs.  One window holds a third of unrelated
vectors at this threshold, so the collisions of a label grow with the square of its different vectors.
"""

from __future__ import annotations

from math import comb, erf, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, small, written

#: Projections, half a window's width in standard deviations of a boundary pair's difference, wanted recall of the count,
#: vectors of a slab.
PROJECTIONS, WINDOW, RECALL, SLAB = 24, 2.0, 0.995, 1500
SEED = 20


def directions(dim: int) -> np.ndarray:
    return np.random.default_rng(SEED).normal(size=(PROJECTIONS, dim))


def calibrated(recall: float = RECALL) -> int:
    """The largest count that a pair at the boundary reaches with probability ``recall``: collisions are binomial there."""
    p = erf(WINDOW / sqrt(2))
    tail, least = 0.0, PROJECTIONS
    while least and (tail := tail + comb(PROJECTIONS, least) * p**least * (1 - p) ** (PROJECTIONS - least)) < recall:
        least -= 1
    return least


def collisions(p: np.ndarray, q: np.ndarray, width: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of ``p`` and ``q`` (projections by row) with at least ``least`` collisions.

    Each projection of ``q`` is sorted; a query's window is a range of that order, marked at its ends and summed up.
    """
    count = np.zeros((len(p), len(q)), np.int8)
    for k in range(p.shape[1]):
        order = np.argsort(q[:, k], kind="stable")
        low, high = (np.searchsorted(q[order, k], p[:, k] + s * width, side) for s, side in ((-1, "left"), (1, "right")))
        mark = np.zeros((len(p), len(q) + 1), np.int8)
        rows = np.arange(len(p))
        mark[rows, low] = 1
        np.subtract.at(mark, (rows, high), 1)
        inside = np.cumsum(mark[:, :-1], axis=1, dtype=np.int8)
        place = np.empty(len(q), np.int64)
        place[order] = np.arange(len(q))
        count += inside[:, place]
    return np.nonzero(count >= least)


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Links that span the same components, at most n - 1."""
    parent = list(range(n))

    def top(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        x, y = top(i), top(j)
        if x != y:
            parent[y] = x
            out.append((i, j))
    return out


def link_vectors(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Vectors of equal label link at a cosine of at least ``threshold``, in double precision.  Those that are null, zero or
    empty, hold null or non-finite components, have a null label or a null vec_id link with nothing.  Vectors of different
    length never link.  n_links counts the other rows linked directly, copies included; component_id is the smallest vec_id
    reachable (its own without links); kept tells vec_id = component_id.  Rows that repeat a vec_id count as rows of their own.
    Other columns are left out; no rows give no rows.
    """
    e = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("e"), F.col("label").cast("string").alias("label"))
    good = "vec_id is not null and label is not null and e is not null and size(e) > 0 and forall(e, x -> x is not null and not isnan(x) and abs(x) < 1.7976931348623157e308D) and exists(e, x -> x <> 0)"
    rows = written(rows.withColumn("good", F.coalesce(F.expr(good), F.lit(False))), "vectors")
    key, key2 = F.xxhash64("label", "e"), F.xxhash64(F.lit(1), "label", "e")
    # equal vectors once, with their number; the vector itself is part of the key, and rows find it again by 128 bits
    once = rows.where("good").withColumn("key", key).withColumn("key2", key2).groupBy("key", "key2", "label", "e").agg(F.count("*").alias("weight"), F.min("vec_id").alias("first"))

    once = written(once, "once")
    width = WINDOW * sqrt(2 - 2 * threshold)
    # slabs of bounded size within a label; every two slabs of a label meet once
    count = written(once.groupBy("label").agg(F.expr(f"int(ceil(count(*) / {SLAB}))").alias("slabs")), "labels")
    slabs = once.join(small(count), "label").withColumn("own", F.expr("int(pmod(key, slabs))"))
    meet = slabs.withColumn("other", F.explode(F.expr("sequence(0, slabs - 1)")))
    meet = meet.select("label", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "first", "weight", "e", F.size("e").alias("dim"))
    least = calibrated()

    def pair_up(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = int(pdf["x"].iat[0]), int(pdf["y"].iat[0])
        pdf = pdf.sort_values("first")
        left, right = pdf[pdf["own"] == x].reset_index(drop=True), pdf[pdf["own"] == y].reset_index(drop=True)
        empty = pd.DataFrame({"a": [], "b": [], "links": []}).astype("int64")
        if not len(left) or not len(right):
            return empty
        unit = []
        for part in (left, right):
            m = np.stack(part["e"].to_numpy()).astype(np.float64)
            m /= np.abs(m).max(1, keepdims=True)
            unit.append(m / np.linalg.norm(m, axis=1, keepdims=True))
        u, v = unit
        axes = directions_of(u.shape[1])
        a_all, b_all, q = [np.empty(0, np.int64)], [np.empty(0, np.int64)], v @ axes.T
        for i in range(0, len(u), 512):
            a, b = collisions(u[i : i + 512] @ axes.T, q, width, least)
            a += i
            if x == y:
                a, b = a[a < b], b[a < b]
            for j in range(0, len(a), 100_000):
                p, r = a[j : j + 100_000], b[j : j + 100_000]
                near = np.einsum("ij,ij->i", u[p], v[r]) >= threshold
                a_all.append(p[near])
                b_all.append(r[near])
        a, b = np.concatenate(a_all), np.concatenate(b_all)
        wl, wr = left["weight"].to_numpy(), right["weight"].to_numpy()
        fl, fr = left["first"].to_numpy(), right["first"].to_numpy()
        down, up = np.bincount(a, wr[b], len(left)).astype(np.int64), np.bincount(b, wl[a], len(right)).astype(np.int64)
        tree = _forest(a, b + (0 if x == y else len(left)), len(left) + (0 if x == y else len(right)))
        names = fl if x == y else np.r_[fl, fr]
        out = [pd.DataFrame({"a": fl[down > 0], "b": fl[down > 0], "links": down[down > 0]}), pd.DataFrame({"a": fr[up > 0], "b": fr[up > 0], "links": up[up > 0]})]
        out.append(pd.DataFrame({"a": [names[i] for i, _ in tree], "b": [names[j] for _, j in tree], "links": 0}))
        return pd.concat(out).astype("int64")

    found = written(meet.groupBy("label", "x", "y", "dim").applyInPandas(pair_up, "a long, b long, links long"), "found")
    linked = found.where("a = b").groupBy("a").agg(F.sum("links").alias("links")).select(F.col("a").alias("first"), "links")
    group = connected_components(found.where("a <> b").select("a", "b")).select(F.col("node").alias("first"), F.col("component"))
    named = once.select("key", "key2", "first", "weight", "label").join(linked.hint("merge"), "first", "left").join(group.hint("merge"), "first", "left")
    per_vector = written(named.select("key", "key2", F.coalesce("component", "first").alias("c"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links")), "pervector")
    out = rows.withColumn("key", F.when(F.col("good"), key)).withColumn("key2", key2).join(small(per_vector), ["key", "key2"], "left")
    own = F.coalesce("c", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(F.col("vec_id") == own, F.lit(False)).alias("kept"))


_AXES: dict[int, np.ndarray] = {}


def directions_of(dim: int) -> np.ndarray:
    if dim not in _AXES:
        _AXES[dim] = directions(dim)
    return _AXES[dim]
