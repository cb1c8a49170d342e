"""Lexical retrieval packing: a sharded BM25 index returns unused neighbours of each seed document, which fill its window.

Texts are tokenized once into a written table.  Document frequencies and lengths come from all of it; they are bounded by the
vocabulary.  Documents are then dealt by content: in the order of their rarest terms, by ranges, so that those that share such
terms meet wherever they stood in the input; a term of many documents is split by the next ones, then by a hash.  Each task reads
its range in shards of bounded tokens, indexes a shard and packs it, so no group grows with the data.  A range is sorted by content,
so a rerun after a lost executor gives the same result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import codec
from .common import bounded_batches, written

#: BM25 constants, rarest terms that deal a document, neighbours fetched at a time, most terms of whole rows, and a shard's bounds.
K1, B, KEYS, FETCH, WHOLE = 1.2, 0.75, 3, 48, 512
SHARD_DOCS, SHARD_TOKENS = 4096, 6_000_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def token_table(docs: DataFrame, path: str, eos: int) -> DataFrame:
    """doc_id and its ids as little-endian unsigned 32-bit (or 16-bit, where the vocabulary allows) integers, ended by ``eos``."""

    def run(batches):
        c = codec(path)
        kind = "<u2" if c.size <= 1 << 16 else "<u4"
        for b in batches:
            rows = [np.append(ids, eos).astype(kind).tobytes() for ids in c.encode([t or "" for t in b.column(1).to_pylist()])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.large_binary()).cast(pa.binary()), pa.array([c.size] * len(rows), pa.int32())], names=["doc_id", "ids", "size"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(run, "doc_id long, ids binary, size int")


def _ids(blob: bytes, size: int) -> np.ndarray:
    return np.frombuffer(blob, "<u2" if size <= 1 << 16 else "<u4")


def _terms(rows: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and frequency of each different term of each row, by row."""
    kind = np.uint32 if len(rows) * size < 1 << 32 else np.int64  # narrow keys sort faster
    key = np.repeat(np.arange(len(rows), dtype=kind) * kind(size), [len(r) for r in rows]) + np.concatenate(rows)
    key.sort()
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    row, term = np.divmod(key[first], kind(size))
    return row.astype(np.int32), term.astype(np.int32), np.diff(np.r_[first, len(key)]).astype(np.int32)


def term_statistics(tokens: DataFrame) -> tuple[np.ndarray, int, float]:
    """Document frequency of each id over all documents, their number, and their mean length; bounded by the vocabulary."""

    def run(batches):
        df, n, total = None, 0, 0
        for b in batches:
            if b.num_rows:
                size = b.column(1)[0].as_py()
                df = np.zeros(size, np.int64) if df is None else df
                blobs = b.column(0).to_pylist()
                for i in range(0, len(blobs), 512):
                    rows = [_ids(x, size) for x in blobs[i : i + 512]]
                    df += np.bincount(_terms(rows, size)[1], minlength=size)
                    total += sum(map(len, rows))
                n += len(blobs)
        if df is not None:
            at = np.flatnonzero(df)
            yield pa.RecordBatch.from_pydict({"term": np.r_[at, -1, -2], "n": np.r_[df[at], n, total]})

    sums = tokens.select("ids", "size").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    found = dict(zip(sums["term"].tolist(), sums["n"].tolist(), strict=True))
    df = np.zeros(max([0, *found]) + 1, np.int64)
    for t, n in found.items():
        if t >= 0:
            df[t] = n
    return df, found.get(-1, 0), found.get(-2, 0) / max(1, found.get(-1, 0))


def by_content(tokens: DataFrame, df: np.ndarray) -> DataFrame:
    """``tokens`` dealt and sorted by each document's KEYS rarest terms that another document holds too."""
    names = [f"key{k}" for k in range(KEYS)]

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                size = part.column(2)[0].as_py()
                doc, term, _ = _terms([_ids(x, size) for x in part.column(1).to_pylist()], size)
                doc, term = doc[df[term] > 1], term[df[term] > 1]
                order = np.lexsort((term, df[term], doc))
                doc, term = doc[order], term[order]
                place = np.arange(len(doc)) - np.searchsorted(doc, doc)
                keys = np.full((KEYS, part.num_rows), -1, np.int32)
                keys[place[place < KEYS], doc[place < KEYS]] = term[place < KEYS]
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(k) for k in keys)], names=["doc_id", "ids", "size", *names])

    keyed = tokens.mapInArrow(run, "doc_id long, ids binary, size int, " + ", ".join(f"{k} int" for k in names))
    order = [*names, F.xxhash64("ids"), "doc_id"]
    return keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "ids", "size")


class Shard:
    """An inverted index over some documents, with corpus-wide weights.

    At most WHOLE terms, each of an eighth of the documents or more, are kept as whole rows of weights, the others as lists of their
    documents.  Whenever half of the documents are used, these leave the index, which changes no score of the others.
    """

    def __init__(self, rows: list[np.ndarray], size: int, idf: np.ndarray, mean: float):
        self.rows, self.n = rows, len(rows)
        doc, term, tf = _terms(rows, size)
        length = np.array([len(r) for r in rows])
        norm = K1 * (1 - B + B * length / max(mean, 1e-9))
        self.begin = np.searchsorted(doc, np.arange(self.n + 1, dtype=doc.dtype))
        self.terms = term
        order = np.argsort(term, kind="stable")
        self.doc, by_term = doc[order], term[order]
        self.weight = idf[by_term] * tf[order] * (K1 + 1) / (tf[order] + norm[self.doc])
        self.at = np.searchsorted(by_term, np.arange(size + 1, dtype=by_term.dtype))
        self.free, self.left, self.indexed = np.ones(self.n, bool), self.n, np.arange(self.n)
        held = np.diff(self.at)
        common = np.flatnonzero(held >= max(2, self.n / 8))
        common = common[np.argsort(-held[common], kind="stable")[:WHOLE]]
        self.whole, self.row = np.zeros((len(common), self.n), np.float32), np.full(size, -1)
        self.row[common] = np.arange(len(common))
        row = self.row[by_term]
        self.whole[row[row >= 0], self.doc[row >= 0]] = self.weight[row >= 0]
        self._keep((row < 0) & (held[by_term] > 1))

    def _keep(self, posts: np.ndarray) -> None:
        self.doc, self.weight, self.at = self.doc[posts], self.weight[posts], np.r_[0, np.cumsum(posts)][self.at]

    def use(self, row: int) -> None:
        """Take a document out of the answers."""
        self.free[row] = False
        self.left -= 1
        if 2 * self.left < len(self.indexed):
            self.whole = self.whole[:, self.free[self.indexed]]
            self.indexed = np.flatnonzero(self.free)
            self._keep(self.free[self.doc])

    def neighbours(self, seed: int, want: int) -> list[int]:
        """Unused documents by falling BM25 score for all terms of the seed, at most ``want``."""
        terms = self.terms[self.begin[seed] : self.begin[seed + 1]]
        score = np.zeros(self.n)
        listed = terms[self.at[terms + 1] > self.at[terms]]
        if len(listed):
            posts = [slice(b, e) for b, e in zip(self.at[listed].tolist(), self.at[listed + 1].tolist(), strict=True)]
            score = np.bincount(np.concatenate([self.doc[s] for s in posts]), np.concatenate([self.weight[s] for s in posts]), self.n)
        total = np.zeros(len(self.indexed), np.float32)
        for k in self.row[terms][self.row[terms] >= 0].tolist():
            total += self.whole[k]
        score[self.indexed] += total
        score *= self.free
        found = np.flatnonzero(score > 0)
        if len(found) > want:
            found = found[np.argpartition(-score[found], want)[:want]]
        return found[np.lexsort((found, -score[found]))].tolist()

    def pieces(self, window: int):
        """(row, start, length, sequence, offset) of each piece; only full sequences and powers of two arise.

        The document that opens a window asks for its neighbours, FETCH at a time until the window is full; when no unused
        document shares a term with it, the next unused one opens a ranking of its own.
        """
        out, sequence, room, unused = [], 0, window, iter(range(self.n))
        seed, start, queue, asker = None, 0, [], None
        total = sum(map(len, self.rows))
        while total:
            if seed is None:
                while queue and not self.free[queue[-1]]:
                    queue.pop()
                if not queue and asker is not None:  # further down the window's own ranking
                    queue = self.neighbours(asker, FETCH)[::-1]
                if queue:
                    seed = queue.pop()
                else:
                    seed = asker = next(i for i in unused if self.free[i])
                self.use(seed)
                start = 0
            if room == window:
                asker, queue = seed, self.neighbours(seed, FETCH)[::-1]
            if room == window and total < window:
                room = 1 << (total.bit_length() - 1)  # the shard's rest: powers of two, which need no padding
                window = room
            size = min(room, len(self.rows[seed]) - start)
            out.append((seed, start, size, sequence, window - room))
            start, room, total = start + size, room - size, total - size
            if start == len(self.rows[seed]):
                seed = None
            if not room:
                sequence, room = sequence + 1, window
        return out


def pack(docs: DataFrame, path: str, window: int = 4096, eos: int = 2) -> DataFrame:
    """Pack all documents (doc_id, text) into sequences of at most ``window`` tokens.

    One row per piece: doc_id, start (its document's ids before it), length, ids_crc32 (of little-endian unsigned 32-bit ids),
    doc_tokens (with the closing ``eos``), sequence_id, offset (in the sequence, gapless from 0).  A cut document's rest opens
    the next sequence as its seed.  Null and empty texts have the one id ``eos``.  A null doc_id stays null, repeated doc_ids
    are packed row by row, other columns are left out, and no rows give no rows.  ``window`` should be a power of two; a
    shard's last tokens form sequences whose lengths are falling powers of two.
    """
    bounded_batches(docs.sparkSession)
    tokens = written(token_table(docs, path, eos), "tokens")
    df, n, mean = term_statistics(tokens)

    def run(batches):
        task = TaskContext.get().partitionId() << 36
        made = 0

        def shard(ids, rows, size):
            nonlocal made
            idf = np.log1p((n - df + 0.5) / (df + 0.5))
            idf = np.concatenate([idf, np.zeros(max(0, size - len(idf)))])
            made_here = 0
            cols = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")}
            for row, start, length, sequence, offset in Shard(rows, size, idf, mean).pieces(window):
                part = rows[row][start : start + length]
                for k, v in zip(cols, (ids[row], start, length, zlib.crc32(part.astype("<u4").tobytes()), len(rows[row]), task + made + sequence, offset), strict=True):
                    cols[k].append(v)
                made_here = sequence + 1
            made += made_here
            return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in cols.values()], names=list(cols))

        ids, rows, total, size = [], [], 0, 0
        for b in batches:
            for i, blob, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                ids.append(i)
                rows.append(_ids(blob, size))
                total += len(rows[-1])
                if len(rows) >= SHARD_DOCS or total >= SHARD_TOKENS:
                    yield shard(ids, rows, size)
                    ids, rows, total = [], [], 0
        if rows:
            yield shard(ids, rows, size)

    return by_content(tokens, df).mapInArrow(run, PIECES)
