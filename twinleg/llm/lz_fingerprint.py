"""Lempel-Ziv phrase fingerprints: parse a text into dictionary phrases, hash the phrases, keep the smallest hashes.

Two texts that compress well together share phrases, so the likeness of their bottom-k sketches estimates the Jaccard
similarity of their phrase sets.  The parse of a common prefix is shared between a document and its edited text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import mixed
from .common import schema_with

#: Hashes in a sketch.
K = 64


class Parser:
    """LZ78 over bytes: a phrase is a known phrase and one byte more.  Nodes are numbered in the order they arise."""

    def __init__(self):
        self.known: dict[int, int] = {}
        self.node = 0

    def feed(self, data: bytes) -> None:
        known, node = self.known, self.node
        get, size = known.get, len(known)
        for c in data:
            key = node << 8 | c
            node = get(key)
            if node is None:
                size += 1
                known[key] = size
                node = 0
        self.node = node

    def copy(self) -> Parser:
        other = Parser()
        other.known, other.node = self.known.copy(), self.node
        return other


def sketches(parsers: list[Parser], k: int = K) -> list[np.ndarray]:
    """The k smallest 32-bit phrase hashes of each parse, ascending; fewer where there are fewer phrases."""
    size = np.array([len(p.known) for p in parsers])
    if not size.sum():
        return [np.empty(0, np.uint32) for _ in parsers]
    key = np.concatenate([np.fromiter(p.known, np.int64, len(p.known)) for p in parsers])
    base = np.repeat(np.cumsum(size) - size, size)
    parent, byte = (key >> 8) + base, mixed((key & 255).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    root = (key >> 8) == 0
    h = np.zeros(len(key) + 1, np.uint64)  # a phrase's hash is at its number, so a parent's is one place before its row
    h[1:][root] = mixed(byte[root])
    todo = np.flatnonzero(~root)
    ready = np.r_[False, root]
    while len(todo):
        now = ready[parent[todo]]
        at = todo[now]
        h[at + 1] = mixed(h[parent[at]] * np.uint64(0xD1342543DE82EF95) + byte[at])
        ready[at + 1] = True
        todo = todo[~now]
    out = []
    for part in np.split((h[1:] >> np.uint64(32)).astype(np.uint32), np.cumsum(size)[:-1]):
        if len(part) > 4 * k:
            part = np.partition(part, 2 * k)[: 2 * k]
        out.append(np.unique(part)[:k])
    return out


def likeness(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Share of the union's k smallest hashes that both sketches hold; two texts without phrases are alike."""
    if not len(a) and not len(b):
        return 1.0
    union = np.union1d(a, b)[:k]
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.isin(union, both).sum() / len(union))


def shown(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """Add the fingerprint (hexadecimal, 8 digits a hash) of ``text`` to every row; null and empty texts have an empty one."""
    docs = docs.drop(out)

    def run(batches):
        for b in batches:
            made = []
            for t in b.column(b.schema.get_field_index(text)).to_pylist():
                p = Parser()
                p.feed((t or "").encode())
                made.append(shown(sketches([p])[0]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.string())], names=[*b.schema.names, out])

    return docs.mapInArrow(run, schema_with(docs, **{out: "string"}))


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _in_order(docs: DataFrame, chars_per_part: int) -> DataFrame:
    """(part, doc_id, text, real): documents in ranges of falling doc_id, each range ended by the next one's first document.

    Ranges are cut at quantiles of doc_id; the rows that start them are found by an aggregation with one row for each range,
    and the last range is ended by the very first document.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    stats = rows.select("doc_id", F.octet_length("text").alias("n")).agg(F.sum("n").alias("n"), F.count("doc_id").alias("ids")).first()
    parts = max(1, min(20_000, (stats["n"] or 0) // chars_per_part, stats["ids"] or 0))
    cuts = sorted(set(rows.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.2 / parts)), reverse=True) if parts > 1 else []
    # a null doc_id comes last; equal ids are ordered by text.  Cuts are searched in two steps of about the square root each.
    step = max(1, int(len(cuts) ** 0.5))
    every, coarse = (f"from_json('{[int(c) for c in x]}', 'array<bigint>')" for x in (cuts, cuts[::step]))
    k = f"greatest(size(filter({coarse}, c -> c >= doc_id)) - 1, 0) * {step}"
    part = F.expr(f"if(doc_id is null, {len(cuts)}, {k} + size(filter(slice({every}, {k} + 1, {step}), c -> c >= doc_id)))")
    rows = rows.withColumn("part", part)
    top = F.max_by(F.struct("part", "doc_id", F.sha2("text", 256).alias("h")), F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))), F.sha2("text", 256))).alias("top")
    heads = sorted((r["top"] for r in rows.groupBy("part").agg(top).collect()), key=lambda t: t["part"])
    if not heads:
        return rows.select("part", "doc_id", "text", F.lit(True).alias("real"))
    spark = docs.sparkSession
    ends = spark.createDataFrame([(heads[i]["part"], h["doc_id"], h["h"]) for i, h in enumerate([*heads[1:], heads[0]])], "to int, head_id long, h string")
    mark = F.broadcast(ends)
    tail = rows.join(mark, F.expr("doc_id <=> head_id") & (F.sha2("text", 256) == F.col("h")))
    tail = tail.groupBy("to").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text")).select(F.col("to").alias("part"), "doc_id", "text", F.lit(False).alias("real"))
    return rows.select("part", "doc_id", "text", F.lit(True).alias("real")).unionAll(tail)


def compare_with_next(docs: DataFrame, chars_per_part: int = 2 << 20) -> DataFrame:
    """Fingerprint every document, its edited text, and its likeness to the next document by descending doc_id.

    The edited text has its last floor(n_chars / 3) code points replaced by the first as many (or all) of the next document;
    after the last document comes the first.  Null texts count as empty; a null doc_id comes last; equal ids go by the digest
    of their text, falling; other columns are left out; a single document is its own next; no rows give no rows.
    """
    ordered = _in_order(docs, chars_per_part)
    n = max(1, ordered.select("part").distinct().count())
    rows = ordered.withColumn("h", F.sha2("text", 256)).repartition(n, "part").sortWithinPartitions("part", F.desc("real"), F.desc_nulls_last("doc_id"), F.desc("h")).select("part", "doc_id", "text", "real")

    def run(batches):
        held = None  # part, doc_id, text, parse of the text, its sketch

        def made(before, text, sketch):
            _, doc_id, own, own_sketch, prefix, cut = before
            tail = text[: len(own) // 3].encode()
            changed = prefix
            changed.feed(tail)
            edited = sketches([changed])[0]
            return (doc_id, len(own), hashlib.sha256(own[:cut].encode() + tail).hexdigest(), shown(own_sketch), shown(edited), likeness(own_sketch, edited), likeness(own_sketch, sketch))

        for b in batches:
            out = []
            for part, doc_id, text, real in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if not real and held is None:
                    continue
                cut = len(text) - len(text) // 3
                p = Parser()
                p.feed(text[:cut].encode())
                prefix = p.copy()
                p.feed(text[cut:].encode())
                sketch = sketches([p])[0]
                if held is not None:
                    out.append(made(held, text, sketch))
                held = (part, doc_id, text, sketch, prefix, cut) if real else None
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), ARROW, strict=True)], names=[x.split()[0] for x in RESULT.split(", ")])

    return rows.mapInArrow(run, RESULT)


ARROW = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[x.split()[1]] for x in RESULT.split(", ")]
