"""N-gram Jaccard self-join by prefix filters under several global token orders.

A document is the set of its hashed word shingles; documents of equal sets are one node.  Under any global order of the
shingles, two sets with Jaccard similarity of at least t share one of their first ``n - ceil(t * n) + 1`` shingles.  Every order
here puts shingles that many documents hold last, in classes of their frequency, and breaks ties by a hash of its own.

The nodes that hold one prefix shingle are a block; blocks of the same nodes are one.  Nodes of the first order's blocks are
kept with their sets, and blocked again under the other orders.  A candidate pair shares a block under every order, and its
sizes and parity masks leave room for the similarity; then the sets are verified exactly.  First every node asks the hubs of its
blocks, at most one of them, which is linear; where a block still spans several components, tasks of bounded slabs compare across
its components and give the closest pairs that join them, fewer than its nodes; last, across what are components then, all pairs
that pass every filter.  Pairs within a component need no check, so a group of copies is never expanded into all its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import mixed, powers
from .common import bounded_batches, connected_components, discard, schema_with, small, written

#: Orders, largest size of the table of frequent shingles, documents that make a shingle frequent, rounds of hubs, nodes of a
#: small block and of a slab, and posts of a frequent shingle that are dealt together.
ORDERS, FREQUENT_ROWS, FREQUENT, HUB_ROUNDS, FEW, SLAB, CELL = 3, 400_000, 16, 1, 32, 2048, 1 << 16
#: Bytes of text that are hashed at once, shingles among which repeats are looked for, and counts that a task holds.
CHUNK, COUNTED, COUNTS = 1 << 18, 1 << 19, 1 << 18
#: Names of the parts of a set's parity mask: 512 bits, each flipped by the shingles that fall on it.
PARITY = [f"k{i}" for i in range(8)]
#: Bits of the mask that candidates pass before their sets are fetched: long sets fill 512 bits, and are the costly ones.
WIDE = 4096
GOLD = 0x9E3779B97F4A7C15
#: A node: the smallest doc_id of its set, and the first half of the set's signature.
NODE = "struct<d:bigint,s:bigint>"

_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(GOLD))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True


def shingles(texts: list[str], n: int) -> list[np.ndarray]:
    """Sorted different 64-bit hashes of each text's n-word shingles; with fewer words, of the whole sequence as one."""
    raw = [b" " + t.encode() + b" " for t in texts]
    size = np.array([len(r) for r in raw])
    data = _LOWER[np.frombuffer(b"".join(raw), np.uint8)]
    gap = _GAP[data]
    begin, end = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1, np.flatnonzero(~gap[:-1] & gap[1:]) + 1
    up, down = powers(len(data))
    total = np.r_[np.uint64(0), np.cumsum(_BYTE[data] * up[: len(data)])]
    words = mixed((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64) * np.uint64(GOLD))
    word_at = np.searchsorted(begin, np.r_[0, np.cumsum(size)])
    joined = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for k in range(n):
        joined = mixed(joined + words[k : k + len(joined)] * np.uint64(2 * k + 3))
    out = []
    for a, b in zip(word_at[:-1].tolist(), word_at[1:].tolist(), strict=True):
        if b - a >= n:
            own = np.sort(joined[a : b - n + 1])
            out.append(own[np.r_[True, own[1:] != own[:-1]]])
        elif b > a:
            h = np.zeros(1, np.uint64)
            for k in range(b - a):
                h = mixed(h + words[a + k : a + k + 1] * np.uint64(2 * k + 3))
            out.append(mixed(h + np.uint64(b - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def _sets(batches, n: int):
    """(doc_id, set) in chunks; only a chunk's texts are Python strings at a time."""
    for b in batches:
        ids, texts = b.column(0).to_pylist(), b.column(1)
        size = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
        i = 0
        while i < len(size):
            j, total = i, 0
            while j < len(size) and (j == i or total + size[j] < CHUNK):
                total += size[j]
                j += 1
            yield ids[i:j], shingles([t or "" for t in texts.slice(i, j - i).to_pylist()], n)
            i = j


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set; both 0 for the empty one."""
    out = np.zeros((2, len(sets)), np.uint64)
    for i, s in enumerate(sets):
        if len(s):
            other = mixed(s + np.uint64(GOLD))
            pair = np.array([s.sum(dtype=np.uint64) ^ np.bitwise_xor.reduce(other), other.sum(dtype=np.uint64) ^ np.bitwise_xor.reduce(mixed(other))], np.uint64)
            out[:, i] = np.maximum(mixed(pair + np.uint64(len(s))), np.uint64(1))
    return out[0].view(np.int64), out[1].view(np.int64)


def masks(sets: list[np.ndarray], bits: int = 512) -> np.ndarray:
    """The parity mask of each set: bit b of ``bits`` (a power of two) tells whether an odd number of its shingles falls on b."""
    shift = np.uint64(65 - bits.bit_length())
    return np.stack([np.packbits(np.bincount((mixed(s) >> shift).astype(np.int64), minlength=bits).astype(np.uint8) & 1).view(np.int64) for s in sets])


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Different shingles of several counts, and the sums of their times."""
    token, times = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.argsort(token)
    token, times = token[order], times[order]
    first = np.flatnonzero(np.r_[True, token[1:] != token[:-1]]) if len(token) else np.empty(0, np.int64)
    return token[first], np.add.reduceat(times, first) if len(first) else times


def _repeats(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that more than one of the sets hold, and how many do."""
    flat = np.sort(np.concatenate(sets))
    first = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
    times = np.diff(np.r_[first, len(flat)])
    return flat[first[times > 1]], times[times > 1]


def _describe(docs: DataFrame, n: int) -> DataFrame:
    """Rows (doc_id, n, s1, s2, mask) of the documents, and rows (token, times) of shingles that COUNTED of a task hold more than once."""
    names = ["doc_id", "n", "s1", "s2", *PARITY, "token", "times"]

    def counted(token, times):
        none = pa.nulls(len(token), pa.int64())
        return pa.RecordBatch.from_arrays([none] * 12 + [pa.array(token.view(np.int64)), pa.array(times.astype(np.int64))], names=names)

    def run(batches):
        # sets that are equal count once in a window
        window: dict[tuple[int, int], np.ndarray] = {}
        size, parts = 0, []
        for ids, sets in _sets(batches, n):
            s1, s2 = signatures(sets)
            none, odd = pa.nulls(len(ids), pa.int64()), masks(sets)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(s1), pa.array(s2), *(pa.array(odd[:, k]) for k in range(8)), none, none], names=names)
            for x, y, s in zip(s1.tolist(), s2.tolist(), sets, strict=True):
                if len(s) and (x, y) not in window:
                    window[x, y] = s
                    size += len(s)
            if size >= COUNTED:
                parts.append(_repeats(list(window.values())))
                window, size = {}, 0
                if sum(len(p[0]) for p in parts) > COUNTS:
                    parts = [_added(parts)]
                    if len(parts[0][0]) > COUNTS // 2:
                        yield counted(*parts.pop())
        if window:
            parts.append(_repeats(list(window.values())))
        if parts:
            yield counted(*_added(parts))

    return docs.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def frequent_shingles(described: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, sorted, and their counts: at most FREQUENT_ROWS, whatever the input."""
    counts = written(described.where("token is not null").groupBy("token").agg(F.sum("times").alias("times")).where(f"times >= {FREQUENT}"), "frequent")
    sizes = {r["c"]: r["n"] for r in counts.groupBy(F.floor(F.log2("times")).cast("int").alias("c")).agg(F.count("*").alias("n")).collect()}
    least, total = 64, 0
    for c in sorted(sizes, reverse=True):
        if total + sizes[c] > FREQUENT_ROWS:
            break
        total, least = total + sizes[c], c
    rows = counts.where(F.floor(F.log2("times")) >= least).toPandas()
    token, times = rows["token"].to_numpy(np.int64).view(np.uint64), rows["times"].to_numpy(np.int64)
    order = np.argsort(token)
    return token[order], times[order]


def prefix_size(n: int, num: int, den: int) -> int:
    """n - ceil(n * num / den) + 1."""
    return n + (-n * num // den) + 1


class Orders:
    """The global orders of shingles: classes of frequency (base-2 logarithm), then a hash for each order."""

    def __init__(self, token: np.ndarray, times: np.ndarray, num: int, den: int):
        self.token, self.times, self.num, self.den = token, times, num, den

    def count(self, s: np.ndarray) -> np.ndarray:
        if not len(self.token):
            return np.zeros(len(s), np.int64)
        spot = np.minimum(np.searchsorted(self.token, s), len(self.token) - 1)
        return np.where(self.token[spot] == s, self.times[spot], 0)

    def prefix(self, s: np.ndarray, times: np.ndarray, k: int) -> np.ndarray:
        """Places in ``s`` of its prefix under order ``k``."""
        rank = np.where(times > 0, np.floor(np.log2(np.maximum(times, 1))), 0).astype(np.uint64)
        h = mixed(s ^ np.uint64((k + 1) * GOLD & (1 << 64) - 1)) >> np.uint64(8)  # 56 bits
        p = prefix_size(len(s), self.num, self.den)
        key = h | rank << np.uint64(57)
        return np.argpartition(key, p - 1)[:p] if p < len(s) else np.arange(len(s))


def _posts(docs: DataFrame, n: int, orders: Orders) -> DataFrame:
    """(token, cell, s1): the first order's prefix shingles of every set, once for each set and task (as far as it recalls).

    The posts of a frequent shingle are dealt into cells from 1 on, each of about CELL posts; other shingles have cell 0.
    """

    def run(batches):
        known: set[tuple[int, int]] = set()
        for _, sets in _sets(batches, n):
            s1, s2 = signatures(sets)
            cols = [[], [], []]
            for s, x, y in zip(sets, s1.tolist(), s2.tolist(), strict=True):
                if not len(s) or (x, y) in known:
                    continue
                known.add((x, y))
                times = orders.count(s)
                at = orders.prefix(s, times, 0)
                cells = times[at] // CELL
                cols[0].append(s[at].view(np.int64))
                cols[1].append(np.where(cells > 0, 1 + y % (cells + 1), 0).astype(np.int32))
                cols[2].append(np.full(len(at), x))
            if len(known) > 1 << 18:
                known.clear()
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=["token", "cell", "s1"])

    return docs.mapInArrow(run, "token long, cell int, s1 long")


def _blocks(posts: DataFrame, key: list[str]) -> DataFrame:
    """(block, *key) of the shingles that several nodes hold, those with the same nodes once.  ``posts``: token and key, no repeats."""
    kinds = posts.groupBy("token").agg(F.count("*").alias("size"), F.sum(F.xxhash64(*key).cast("decimal(38,0)")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), *key)).alias("y"))
    chosen = written(kinds.where("size > 1").groupBy("size", "x", "y").agg(F.min("token").alias("token")).select("token"), "chosen")
    return posts.join(small(chosen), "token").withColumnRenamed("token", "block")


def _held(docs: DataFrame, wanted: DataFrame, n: int, orders: Orders) -> DataFrame:
    """The wanted nodes (d, s1, s2) with their sets, wide masks and prefixes under the other orders, once for each of their rows."""
    names = [f"p{k}" for k in range(1, ORDERS)]
    rows = docs.join(small(wanted), docs["doc_id"] == wanted["d"]).select("d", "text", "s1", "s2")

    def run(batches):
        for b in batches:
            start = 0
            for ids, sets in _sets([b.select(["d", "text"])], n):
                own = b.slice(start, len(ids))
                start += len(ids)
                s1, s2 = signatures(sets)
                # other rows of the same doc_id
                fits = (s1 == own.column(2).to_numpy()) & (s2 == own.column(3).to_numpy())
                keep = np.flatnonzero(fits)
                if not len(keep):
                    continue
                sets = [sets[i] for i in keep]
                times = [orders.count(s) for s in sets]
                node = pa.StructArray.from_arrays([own.column(0).take(pa.array(keep)).cast(pa.int64()), pa.array(s1[keep])], names=["d", "s"])
                prefixes = [pa.array([s[orders.prefix(s, t, k)].view(np.int64) for s, t in zip(sets, times, strict=True)], pa.list_(pa.int64())) for k in range(1, ORDERS)]
                sizes, wide = pa.array([len(s) for s in sets], pa.int64()), pa.array([m.tobytes() for m in masks(sets, WIDE)], pa.binary())
                yield pa.RecordBatch.from_arrays([node, pa.array([s.tobytes() for s in sets], pa.binary()), sizes, wide, *prefixes], names=["node", "shingles", "n", "wide", *names])

    return rows.mapInArrow(run, f"node {NODE}, shingles binary, n long, wide binary, {', '.join(f'{p} array<bigint>' for p in names)}")


def _close(a: str, b: str, n: str, m: str, num: int, den: int) -> str:
    """Whether sizes and parity masks leave room for the similarity: bits that differ are at most the shingles that differ,
    and these may be (n + m)(1 - t) / (1 + t)."""
    bits = " + ".join(f"bit_count({a}{k} ^ {b}{k})" for k in PARITY)
    return f"least({n}, {m}) * {den} >= greatest({n}, {m}) * {num} and ({bits}) * {den + num} <= ({n} + {m}) * {den - num}"


def _verified(pairs: DataFrame, held: DataFrame, num: int, den: int) -> DataFrame:
    """Of the candidate pairs (a, b) of nodes those that are similar, by their exact sets; a written table.

    Wide masks are compared first, and sets are shuffled only for nodes of pairs that pass.
    """

    def near(batches):
        for b in batches:
            if b.num_rows:
                wide = [np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint64).reshape(b.num_rows, -1) for c in ("va", "vb")]
                bits = np.bitwise_count(wide[0] ^ wide[1]).sum(1, dtype=np.int64)
                keep = bits * (den + num) <= (b.column("na").to_numpy() + b.column("nb").to_numpy()) * (den - num)
                yield b.select(["a", "b"]).filter(pa.array(keep))

    def exact(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column("va"), b.column("vb"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(den * both >= num * (len(x) + len(y) - both))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def joined(pairs: DataFrame, nodes: DataFrame, value: str) -> DataFrame:
        for end in "ab":
            pairs = pairs.join(nodes.select(F.col("node").alias(end), F.col(value).alias("v" + end), F.col("n").alias("n" + end)).hint("merge"), end)
        return pairs.select("a", "b", "va", "vb", "na", "nb")

    schema = f"a {NODE}, b {NODE}"
    close = written(joined(pairs, held, "wide").mapInArrow(near, schema), "close")
    ends = written(close.select(F.col("a").alias("node")).unionAll(close.select(F.col("b").alias("node"))).distinct(), "ends")
    out = written(joined(close, held.join(small(ends), "node", "left_semi"), "shingles").mapInArrow(exact, schema), "links")
    discard(close, ends)
    return out


def _partners(table: pa.Table, num: int, den: int):
    """Of one block's slabs x and y: nodes i, their possible partners j, and the shares of their shingles that differ, as far as wide masks tell.

    Partners are nodes of other components whose sizes and masks leave room for the similarity; each pair comes once.  Of the
    commonest component only the pairs with others are tried.
    """
    x, y = (table.column(c)[0].as_py() for c in ("x", "y"))
    own, n, label = (table.column(c).to_numpy() for c in ("own", "n", "label"))
    _, label = np.unique(label, return_inverse=True)
    common = np.bincount(label).argmax()
    left, right = np.flatnonzero(own == x), np.flatnonzero(own == y)
    if x == y:
        left = left[label[left] != common]
    if not len(left) or not len(right):
        return
    mask = np.stack([table.column(k).to_numpy() for k in PARITY], 1).view(np.uint64)
    wide = np.frombuffer(b"".join(table.column("wide").to_pylist()), np.uint64).reshape(len(n), -1)
    for i in left.tolist():
        j = right[label[right] != label[i]]
        if x == y:
            j = j[(j > i) | (label[j] == common)]
        j = j[np.minimum(n[j], n[i]) * den >= np.maximum(n[j], n[i]) * num]
        for m in (mask, wide):
            bits = np.bitwise_count(m[j] ^ m[i]).sum(1, dtype=np.int64)
            room = bits * (den + num) <= (n[i] + n[j]) * (den - num)
            j, bits = j[room], bits[room]
        if len(j):
            yield i, j, bits / (n[i] + n[j])


def _pairs(table: pa.Table, a: np.ndarray, b: np.ndarray) -> pa.Table:
    node = table.column("node").combine_chunks()
    return pa.table({"a": node.take(pa.array(a, pa.int64())), "b": node.take(pa.array(b, pa.int64()))})


def across(table: pa.Table, num: int, den: int) -> pa.Table:
    """Of one block's slabs x and y all pairs of possible partners."""
    table = table.combine_chunks()
    none = np.empty(0, np.int64)
    found = [(np.full(len(j), i), j) for i, j, _ in _partners(table, num, den)]
    return _pairs(table, *(np.concatenate([none, *c]) for c in (zip(*found, strict=True) if found else ((), ()))))


def forest(table: pa.Table, num: int, den: int) -> pa.Table:
    """Of one block's slabs x and y pairs of closest possible partners, each of which joins components that those before it don't:
    fewer than components, whatever the number of partners."""
    table = table.combine_chunks()
    least, via = np.full(table.num_rows, np.inf), np.zeros(table.num_rows, np.int64)
    for i, j, share in _partners(table, num, den):
        for here, there in ((j, i), (i, j[share.argmin()])):
            near = share if here is j else share.min()
            better = near < least[here]
            via[here] = np.where(better, there, via[here])
            least[here] = np.where(better, near, least[here])
    label = table.column("label").to_numpy()
    top: dict[int, int] = {}

    def find(k):
        while k in top:
            k = top[k]
        return k

    a, b = [], []
    at = np.flatnonzero(np.isfinite(least))
    for i in at[np.argsort(least[at], kind="stable")].tolist():
        x, y = find(int(label[i])), find(int(label[via[i]]))
        if x != y:
            top[x] = y
            a.append(i)
            b.append(int(via[i]))
    return _pairs(table, np.array(a, np.int64), np.array(b, np.int64))


def partnered(table: pa.Table, num: int, den: int) -> pa.Table:
    """Of one block's slabs x and y the nodes that have a partner there whose size and mask leave room for the similarity."""
    x, y = (table.column(c)[0].as_py() for c in ("x", "y"))
    table = table.combine_chunks()
    own, n = table.column("own").to_numpy(), table.column("n").to_numpy()
    mask = np.stack([table.column(k).to_numpy() for k in PARITY], 1).view(np.uint64)
    left, right = np.flatnonzero(own == x), np.flatnonzero(own == y)
    found = np.zeros(len(n), bool)
    for here, there in ((left, right), (right, left)) if x != y else ((left, right),):
        for i in here.tolist():
            if not found[i]:
                j = there[(np.minimum(n[there], n[i]) * den >= np.maximum(n[there], n[i]) * num) & (there != i)]
                bits = np.bitwise_count(mask[j] ^ mask[i]).sum(1, dtype=np.int64)
                j = j[bits * (den + num) <= (n[i] + n[j]) * (den - num)]
                found[j] = True
                found[i] = len(j) > 0
    return pa.table({"node": table.column("node").combine_chunks().take(pa.array(np.flatnonzero(found)))})


def _slabs(rows: DataFrame, size: DataFrame) -> DataFrame:
    """``rows`` of the large blocks dealt to (block, x, y): slabs of bounded size, every two of which meet once."""
    wide = size.where(f"size > {FEW}").select("block", F.expr(f"int(ceil(size / {SLAB}))").alias("slabs"))
    rows = rows.join(small(wide), "block").withColumn("own", F.expr("int(pmod(xxhash64(node), slabs))")).withColumn("other", F.explode(F.expr("sequence(0, slabs - 1)")))
    return rows.withColumn("x", F.least("own", "other")).withColumn("y", F.greatest("own", "other")).drop("other", "slabs")


def _compared(rows: DataFrame, span: DataFrame, held: DataFrame, chosen) -> DataFrame:
    """Pairs (a < b) that ``chosen`` gives of the slabs of large blocks in ``span``; may repeat."""
    large = rows.join(small(span.where(f"size > {FEW}").select("block")), "block", "left_semi").select("block", "node", "n", F.xxhash64("c").alias("label"), *PARITY)
    met = _slabs(large.join(held.select("node", "wide").hint("merge"), "node"), span).groupBy("block", "x", "y").applyInArrow(chosen, f"a {NODE}, b {NODE}")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _meet(rows: DataFrame, num: int, den: int, test: str = "true") -> DataFrame:
    """Pairs (a, b) of the nodes of each small block whose sizes and masks leave room for the similarity."""
    apart = [c for c in ("c",) if c in rows.columns]
    rows = rows.select("block", "node", "n", *apart, *PARITY).where("block is not null and node is not null").repartition("block")
    right = rows.select("block", F.col("node").alias("b"), F.col("n").alias("m"), *(F.col(c).alias("d") for c in apart), *(F.col(k).alias("h" + k) for k in PARITY))
    left = rows.select(F.col("block").alias("own"), F.col("node").alias("a"), "n", *apart, *PARITY)
    return left.hint("merge").join(right, F.expr(f"own = block and a < b and {test} and {_close('', 'h', 'n', 'm', num, den)}")).select("a", "b")


def _linked(docs: DataFrame, first: DataFrame, n: int, num: int, den: int, orders: Orders, repeated: bool) -> DataFrame:
    """(s1, s2, component): the sets that link with others, and the smallest doc_id that they reach; a written table.

    ``repeated`` tells whether some doc_id has several rows, so that a node may be found more than once.
    """
    # written first, so that both uses share one exchange and the sets are made once
    posts = written(_posts(docs, n, orders), "dealt")
    dealt = posts.where("token is not null and cell is not null").repartition("token", "cell")
    open_ = dealt.groupBy("token", "cell").agg(F.min("s1").alias("lo"), F.max("s1").alias("hi")).where("cell > 0 or lo <> hi").select("token", "cell")
    seen = written(dealt.join(open_.hint("shuffle_hash"), ["token", "cell"], "left_semi").select("token", "s1").distinct(), "posts")
    discard(posts)
    # two sets of one s1 both stand in its blocks
    made = first.select(F.struct(F.col("doc_id").alias("d"), F.col("s1").alias("s")).alias("node"), "s1", "s2", "n", *PARITY)
    marked = written(_blocks(seen, ["s1"]).join(made.hint("merge"), "s1"), "marked")
    size = written(marked.groupBy("block").agg(F.count("*").alias("size")), "sizes")
    # most blocks are chance: only nodes with a partner whose size and mask leave room are wanted
    ends = _meet(marked.join(small(size.where(f"size <= {FEW}").select("block")), "block"), num, den)
    met = _slabs(marked.select("block", "node", "n", *PARITY), size).groupBy("block", "x", "y").applyInArrow(lambda t: partnered(t, num, den), f"node {NODE}")
    alive = ends.select(F.col("a").alias("node")).unionAll(ends.select(F.col("b").alias("node"))).unionAll(met)
    alive = written(alive.distinct(), "alive")
    wanted = written(made.select("node", "s1", "s2", F.col("node.d").alias("d")).join(small(alive), "node").select("d", "s1", "s2"), "wanted")
    held = _held(docs, wanted, n, orders)
    held = written(held.dropDuplicates(["node"]) if repeated else held, "held")
    discard(wanted)
    # the blocks of the other orders; only nodes that have some under each can link
    nodes = alive
    for k in range(1, ORDERS):
        blocks = _blocks(held.select("node", F.explode(f"p{k}").alias("token")), ["node"])
        nodes = nodes.join(blocks.groupBy("node").agg(F.collect_list("block").alias(f"o{k}")).hint("merge"), "node")
    nodes = written(nodes, "nodes")
    rows = written(marked.select("block", "node", "n", *PARITY).join(small(written(nodes.select("node"), "ids")), "node").withColumn("c", F.col("node")), "blocks")

    def shared(pairs: DataFrame) -> DataFrame:
        """Of pairs that share a block of the first order those that share one of every other order."""
        for end in "ab":
            pairs = pairs.join(nodes.select(F.col("node").alias(end), *(F.col(f"o{k}").alias(f"{end}{k}") for k in range(1, ORDERS))).hint("merge"), end)
        return pairs.where(" and ".join(f"arrays_overlap(a{k}, b{k})" for k in range(1, ORDERS))).select("a", "b")

    links = docs.sparkSession.createDataFrame([], f"a {NODE}, b {NODE}")
    tried = links
    for turn in range(HUB_ROUNDS + 2):
        # blocks that still span several components
        payload = F.struct(F.col("node").alias("hub"), F.col("c").alias("d"), F.col("n").alias("m"), *(F.col(k).alias("h" + k) for k in PARITY))
        span = rows.groupBy("block").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("size"), F.min_by(payload, F.xxhash64("node", F.lit(turn))).alias("h")).where("lo < hi")
        span = written(span.select("block", "size", "h.*"), "open")
        if turn > HUB_ROUNDS:
            break
        if turn < HUB_ROUNDS:
            near = rows.join(small(span), "block").where(f"c <> d and {_close('', 'h', 'n', 'm', num, den)}")
            apart = sum((F.bit_count(F.col(k).bitwiseXOR(F.col("h" + k))) for k in PARITY), F.lit(0))
            stars = near.groupBy("node").agg(F.min_by("hub", F.struct(apart, F.col("hub"))).alias("hub"))
            stars = stars.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
        else:
            stars = _compared(rows, span, held, lambda t: forest(t, num, den)).distinct()
        stars = written(stars.join(tried.hint("merge"), ["a", "b"], "left_anti"), "stars")
        tried, links = tried.unionAll(stars), links.unionAll(_verified(shared(stars), held, num, den))
        label = connected_components(links)
        before, rows = rows, rows.drop("c").join(small(label), "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")
        rows = written(rows, "blocks")
        discard(before, span, label)
    # blocks of few nodes are joined with themselves, larger ones cut into slabs of bounded size, every two of which meet once
    pairs = _meet(rows.join(small(span.where(f"size <= {FEW}").select("block")), "block"), num, den, "c <> d")
    pairs = pairs.unionAll(_compared(rows, span, held, lambda t: across(t, num, den)))
    pairs = written(pairs.distinct().join(tried.hint("merge"), ["a", "b"], "left_anti"), "pairs")
    found = connected_components(links.unionAll(_verified(shared(pairs), held, num, den)))
    out = found.join(made.select("node", "s1", "s2").hint("merge"), "node").select("s1", "s2", F.col("component.d").alias("component"))
    out = written(out, "linked")
    discard(seen, marked, size, alive, held, nodes, rows, span, pairs, found)
    return out


def _grouped(docs: DataFrame, n: int, similarity: tuple[int, int]) -> DataFrame:
    """(doc_id, n_shingles, s1, s2, component_id) for every row of ``docs`` (doc_id, text)."""
    num, den = similarity
    bounded_batches(docs.sparkSession)
    described = written(_describe(docs, n), "sets")
    sets = described.where("s1 is not null").select("doc_id", F.col("n").alias("n_shingles"), "s1", "s2", *PARITY)
    own = sets.drop(*PARITY)
    orders = Orders(*frequent_shingles(described), num, den)
    # one node for each different set, with its smallest document
    first = written(sets.where("n_shingles > 0 and doc_id is not null").groupBy("s1", "s2").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("rows"), F.first("n_shingles").alias("n"), *(F.first(k).alias(k) for k in PARITY)), "first")
    repeated = not own.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()
    linked = _linked(docs.where("doc_id is not null"), first, n, num, den, orders, repeated)
    named = first.join(linked.hint("merge"), ["s1", "s2"], "left").where("rows > 1 or component is not null").select("s1", "s2", F.coalesce("component", "doc_id").alias("component"))
    out = own.join(small(written(named, "persets")), ["s1", "s2"], "left")
    return out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))).drop("component")


def join_documents(docs: DataFrame, n: int = 5, similarity: tuple[int, int] = (4, 5)) -> DataFrame:
    """Groups of documents linked by Jaccard similarity of at least ``similarity`` (a fraction) of their n-word shingles.

    One row per row of ``docs``: doc_id, n_shingles (size of the set), component_id (smallest doc_id reachable by links, itself
    included).  A-Z are lower-cased; words are what lies between \\x20 and \\x09-\\x0D; with fewer words than ``n`` the whole
    sequence is one shingle.  Null texts and texts without words have the empty set and link with nothing.  Rows that repeat a
    doc_id are kept; if their texts differ they count as different documents of that id.  A null doc_id links with nothing
    (component_id null).  Other columns are left out; no rows give no rows.  A task holds one text and its set at a time beside
    a chunk of CHUNK bytes, so memory follows the longest text (about 60 bytes a code point).
    """
    return _grouped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), n, similarity).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, n: int = 5, similarity: tuple[int, int] = (4, 5)) -> DataFrame:
    """``docs`` without near-duplicates: of each linked group the document of the smallest doc_id stays.

    Rows of the same doc_id and the same shingles are one document, and the one of smallest hash over all columns stays; rows
    of the same doc_id with other shingles are judged for themselves, and all that share a group's smallest doc_id stay.
    Documents without shingles and rows with a null doc_id all stay.
    """
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    groups = written(_grouped(thin, n, similarity).where("n_shingles > 0 and doc_id is not null").select("doc_id", "s1", "s2", "component_id"), "groups")
    away = written(groups.where("doc_id <> component_id").select("doc_id", "s1", "s2").distinct(), "dropped")
    again = written(groups.where("doc_id = component_id").groupBy("doc_id", "s1", "s2").count().where("count > 1").drop("count"), "again")
    clear = [c for c in docs.columns if c not in ("set_1", "set_2")]
    docs = docs.select(*clear)

    def run(batches):
        for b in batches:
            at = b.schema.get_field_index("text")
            s1, s2 = [], []
            for _, sets in _sets([pa.RecordBatch.from_arrays([pa.nulls(b.num_rows), b.column(at)], names=["doc_id", "text"])], n):
                x, y = signatures(sets)
                s1.append(x)
                s2.append(y)
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(s1)), pa.array(np.concatenate(s2))], names=[*b.schema.names, "set_1", "set_2"])

    marked = docs.mapInArrow(run, schema_with(docs, set_1="long", set_2="long"))
    ids = lambda t: small(t.select(F.col("doc_id").alias("of_id"), "s1", "s2"))
    on = (F.col("doc_id").cast("long") == F.col("of_id")) & (F.col("set_1") == F.col("s1")) & (F.col("set_2") == F.col("s2"))
    kept = marked.join(ids(away), on, "left_anti")
    if again.isEmpty():
        return kept.select(*clear)
    repeated = kept.join(ids(again), on, "left_semi")
    one = repeated.groupBy("doc_id", "set_1", "set_2").agg(F.min_by(F.struct(*clear), F.xxhash64(*clear)).alias("row")).select("row.*")
    return kept.join(ids(again), on, "left_anti").select(*clear).unionByName(one)
