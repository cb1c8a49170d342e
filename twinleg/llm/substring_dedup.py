"""Removal of passages that repeat across documents, by level-wise doubling of windows of words.

Level 0 are windows of half the wanted length.  Of these a document gives the least hash within every wanted window, so two equal
windows of the wanted length always give an equal one, and only a quarter of the places are dealt.  A wanted window goes
on to level 1 only if its short one repeats in another document.  There the windows have the wanted length: each is dealt by 128
bits, and those that start in two documents or more survive.  ``longest_repeats`` goes on doubling from there: a window of
twice the length is a candidate only if both of its halves survived, until no candidates survive.

A level is an aggregation to the least and greatest document of each hash, combined before the shuffle, and a join of the
survivors with the places.  Frequent passages are one row on the small side of that join, which the adaptive plan splits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import mixed, powers
from .common import discard, settle, small, written

#: Words of a window, and bytes of text that are hashed at once.
LENGTH, CHUNK = 13, 1 << 18
GOLD = 0x9E3779B97F4A7C15
#: Two hashes of a byte; words and windows have one of each.
_BYTES = [mixed(np.arange(k, 256 + k, dtype=np.uint64) * np.uint64(GOLD)) for k in (1, 1001)]
_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True
#: A document without doc_id comes after all others.
NO_ID = (1 << 63) - 1


def words(texts: list[bytes], hashes: int = 1) -> tuple[list[np.ndarray], np.ndarray]:
    """``hashes`` hashes of every word of the texts together, and the place of each text's first word, the end added."""
    size = np.array([len(t) + 2 for t in texts])
    data = np.frombuffer(b"".join(b" " + t + b" " for t in texts), np.uint8)
    gap = _GAP[data]
    begin, end = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1, np.flatnonzero(~gap[:-1] & gap[1:]) + 1
    up, down = powers(len(data))
    out = []
    for table in _BYTES[:hashes]:
        total = np.r_[np.uint64(0), np.cumsum(table[data] * up[: len(data)])]
        out.append(mixed((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64) * np.uint64(GOLD)))
    return out, np.searchsorted(begin, np.r_[0, np.cumsum(size)])


def windows(word: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each place."""
    out = np.zeros(max(0, len(word) - n + 1), np.uint64)
    for k in range(n):
        out = mixed(out + word[k : k + len(out)] * np.uint64(2 * k + 3))
    return out


def least_within(word: np.ndarray, length: int) -> np.ndarray:
    """For each window of ``length`` words the least hash of the windows of half that length in it."""
    half = (length + 1) // 2
    short = windows(word, half)
    out = short[: max(0, len(word) - length + 1)]
    for k in range(1, length - half + 1):
        out = np.minimum(out, short[k : k + len(out)])
    return out


def _chunks(batches) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches whose texts take about CHUNK bytes, one text at least, and those texts."""
    for b in batches:
        texts = b.column("text")
        size = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
        i = 0
        while i < len(size):
            j, total = i, 0
            while j < len(size) and (j == i or total + size[j] < CHUNK):
                total += size[j]
                j += 1
            part = b.slice(i, j - i)
            yield part, [(t or "").encode() for t in part.column("text").to_pylist()]
            i = j


def _documents(docs: DataFrame) -> DataFrame:
    """Rows (d, q, doc_id, text): d orders documents, q tells rows of one doc_id with different texts apart and is 0 for others."""
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("d"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    q = F.xxhash64("text")
    several = written(docs.groupBy("d").agg(F.min(q).alias("least"), F.max(q).alias("most")).where("least <> most").select("d", F.lit(True).alias("several")), "several")
    return docs.join(small(several), "d", "left").select("d", F.when(F.col("several"), q).otherwise(F.lit(0)).cast("long").alias("q"), "doc_id", "text")


def _repeated(places: DataFrame, key: list[str]) -> DataFrame:
    """Rows (*key, first) of the keys that several values of d hold, and the least of these; a written table."""
    found = places.groupBy(*key).agg(F.min("d").alias("first"), F.max("d").alias("last")).where("first < last").drop("last")
    found = written(found, "repeated")
    settle(places.sparkSession)
    return found


def _short(length: int):
    def run(batches):
        for part, texts in _chunks(batches):
            (word,), at = words(texts)
            least = least_within(word, length)
            own = np.repeat(np.arange(len(texts)), np.diff(at))[: len(least)]
            fits = np.arange(len(least)) + length <= at[own + 1] if len(least) else np.empty(0, bool)
            own, least = own[fits], least[fits]
            new = np.r_[True, (least[1:] != least[:-1]) | (own[1:] != own[:-1])] if len(own) else np.empty(0, bool)
            own, least = own[new], least[new]
            order = np.lexsort((least, own))
            own, least = own[order], least[order]
            new = np.r_[True, (least[1:] != least[:-1]) | (own[1:] != own[:-1])] if len(own) else np.empty(0, bool)
            own, least = own[new], least[new]
            d, q = (part.column(c).to_numpy(zero_copy_only=False)[own] for c in ("d", "q"))
            yield pa.RecordBatch.from_arrays([pa.array(least.view(np.int64)), pa.array(d, pa.int64()), pa.array(q, pa.int64())], names=["h", "d", "q"])

    return run


def _wanted(length: int):
    def run(batches):
        for part, texts in _chunks(batches):
            (one, two), at = words(texts, 2)
            least, g1, g2 = least_within(one, length), windows(one, length), windows(two, length)
            out = []
            for i, known in enumerate(part.column("known")):
                a, z = at[i], at[i + 1] - length + 1
                if z > a:
                    out.append(a + np.flatnonzero(np.isin(least[a:z], known.values.to_numpy(zero_copy_only=False).view(np.uint64))))
                else:
                    out.append(np.empty(0, np.int64))
            own, place = np.repeat(np.arange(len(texts)), [len(x) for x in out]), np.concatenate(out).astype(np.int64)
            d, q = (part.column(c).to_numpy(zero_copy_only=False)[own] for c in ("d", "q"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(g1[place].view(np.int64)), pa.array(g2[place].view(np.int64)), pa.array(d, pa.int64()), pa.array(q, pa.int64()), pa.array((place - at[own]).astype(np.int32))],
                names=["g1", "g2", "d", "q", "at"],
            )

    return run


def _surviving(docs: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """Places (g1, g2, d, q, at) of candidate windows of ``length`` words, and the windows (g1, g2, first) that repeat; written tables."""
    short = written(docs.select("d", "q", "text").mapInArrow(_short(length), "h long, d long, q long"), "short")
    again = _repeated(short, ["h"])
    held = written(short.join(again.select("h").hint("merge"), "h").groupBy("d", "q").agg(F.collect_set("h").alias("known")), "known")
    discard(short, again)
    settle(docs.sparkSession)
    joined = docs.select("d", "q", "text").join(held.hint("merge"), ["d", "q"])
    places = written(joined.select("d", "q", "text", "known").mapInArrow(_wanted(length), "g1 long, g2 long, d long, q long, at int"), "places")
    discard(held)
    del joined
    settle(docs.sparkSession)
    return places, _repeated(places, ["g1", "g2"])


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_words, n_removed, kept for every row of ``docs`` (doc_id, text); kept is the text's kept words, joined by one space.

    Words are runs without space or U+0009 to U+000D, unchanged.  A word is removed if a window of ``length`` words covers it
    that starts in a document of smaller doc_id too; windows are judged on the input.  A null text has no words.  Rows of equal
    doc_id don't take from each other; rows without doc_id come after all others and don't take from each other.  Other columns
    are left out; no rows give no rows.
    """
    docs = _documents(docs)
    places, firsts = _surviving(docs, length)
    gone = places.join(firsts.hint("merge"), ["g1", "g2"]).where("d > first").groupBy("d", "q").agg(F.collect_set("at").alias("starts"))
    gone = written(gone, "gone")
    discard(places, firsts)
    settle(docs.sparkSession)

    def run(batches):
        for b in batches:
            out = []
            for text, starts in zip(b.column("text"), b.column("starts"), strict=True):
                word = (text.as_py() or "").encode().split()
                removed = 0
                if starts.is_valid:
                    lost = np.zeros(len(word) + 1, np.int32)
                    at = starts.values.to_numpy(zero_copy_only=False)
                    np.add.at(lost, at, 1)
                    np.add.at(lost, at + length, -1)
                    keep = np.cumsum(lost)[:-1] == 0
                    removed = len(word) - int(keep.sum())
                    kept = b" ".join([w for w, k in zip(word, keep.tolist(), strict=True) if k])
                else:
                    kept = b" ".join(word)
                out.append((len(word), removed, kept.decode()))
            n, gone_, kept = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone_, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    whole = docs.join(gone.hint("merge"), ["d", "q"], "left").select("doc_id", "text", "starts")
    return whole.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def longest_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, longest for every row of ``docs`` (doc_id, text): the greatest of length, 2 * length, 4 * length, ... at which a window
    of the document starts in another doc_id too, else 0.  Nulls and repeated rows are taken as ``remove_repeats`` does."""
    docs = _documents(docs)
    places, firsts = _surviving(docs, length)
    found, n = None, length
    while True:
        alive = written(places.join(small(firsts.drop("first")), ["g1", "g2"]), "alive")
        discard(places, firsts)
        level = alive.groupBy("d", "q").agg(F.lit(n).alias("longest"))
        found = written(level if found is None else found.unionAll(level), "longest")
        grouped = alive.groupBy("d", "q").agg(F.collect_set(F.struct("at", "g1", "g2")).alias("alive"))

        def doubled(batches, n=n):
            for b in batches:
                for d, q, alive in zip(b.column("d").to_pylist(), b.column("q").to_pylist(), b.column("alive"), strict=True):
                    at, g1, g2 = (alive.values.field(i).to_numpy(zero_copy_only=False) for i in range(3))
                    order = np.argsort(at)
                    at, g = at[order], [x[order].view(np.uint64) for x in (g1, g2)]
                    after = np.minimum(np.searchsorted(at, at + n), len(at) - 1)
                    has = np.flatnonzero(at[after] == at + n)
                    both = [mixed(x[has] * np.uint64(GOLD) + mixed(x[after[has]])).view(np.int64) for x in g]
                    yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1]), pa.array([d] * len(has), pa.int64()), pa.array([q] * len(has), pa.int64()), pa.array(at[has], pa.int32())], names=["g1", "g2", "d", "q", "at"])

        places = written(grouped.mapInArrow(doubled, "g1 long, g2 long, d long, q long, at int"), "places")
        discard(alive)
        firsts = _repeated(places, ["g1", "g2"])
        if firsts.isEmpty():
            break
        n *= 2
    best = written(found.groupBy("d", "q").agg(F.max("longest").cast("long").alias("longest")), "best")
    return docs.select("doc_id", "d", "q").join(small(best), ["d", "q"], "left").select("doc_id", F.coalesce("longest", F.lit(0)).cast("long").alias("longest"))
