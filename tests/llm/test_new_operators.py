"""Conversation repair, substring removal and hard negatives against brute force, with nulls, ties, repeats and empty tables."""

import hashlib
import itertools
import math
import os
import random
import re
import zlib

import pytest

from twinleg.llm import conversation_repair as C
from twinleg.llm import hard_negatives as H
from twinleg.llm import substring_dedup as S

TURNS = "conv_id long, turn long, role string, text string"


def all_audits(turns):
    """Every cheapest (cost, audit, repaired) by trying all edits, with at most two insertions at a place."""
    best = {}

    def go(i, state, cost, audit, out):
        key = (i, state)
        for n in range(3):
            s, o = state, list(out)
            for _ in range(n):
                s = C.ONWARD[s]
                o.append(f"{C.NAME[s]}:")
            c, a = cost + 5 * n, audit + "I" * n
            if i == len(turns):
                if s in (C.START, C.ASSISTANT):
                    best["end"] = min(best.get("end", (10**9,)), (c, a, "\n".join(o)))
                continue
            role, text, fault = turns[i]
            stays = 5 if fault == C.CUT else 0
            yield_to = [(s, 2, "D", None)]
            if fault in (C.FINE, C.CUT):
                yield_to.append((C.ONWARD[s], 1 + stays, "R", f"{C.NAME[C.ONWARD[s]]}:{text}"))
                if C.kept(s, role[:1]) is not None:
                    yield_to.append((C.kept(s, role[:1]), stays, "K", f"{role}:{text}"))
            for t, k, e, line in yield_to:
                go(i + 1, t, c + k, a + e, o if line is None else [*o, line])
        return key

    go(0, C.START, 0, "", [])
    return best["end"]


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        body = text.strip(C.GAPS)
        out.append((role, text, C.BLANK if not body else C.DUPLICATE if (role, text) in seen else C.CUT if body[-1] not in ".!?" else C.FINE))
        seen.add((role, text))
    return out


def test_report_equals_every_way_tried(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for c in range(60):
        said = [(i, rng.choice(["user", "assistant", "assistant", "system", "tool", "user"]), rng.choice(["Yes.", "No!", "cut off", " \t", "Why? ", "Hm."])) for i in range(rng.randrange(0, 7))]
        rows += [(c, *x) for x in said]
        turns = faults([x[1:] for x in said])
        cost, audit, text = all_audits(turns)
        count = [sum(f == k for *_, f in turns) for k in (C.BLANK, C.DUPLICATE, C.CUT)]
        illegal = sum(a[0][0] + b[0][0] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
        want[c] = (0, *count, illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    ids = spark.createDataFrame([(c,) for c in range(60)], "conv_id long")
    frame = spark.createDataFrame(rows, TURNS)
    got = {r[0]: tuple(r[1:]) for r in C.report(frame, ids).collect()}
    assert got == want
    lines = {}
    for r in sorted(C.repaired(frame.withColumn("key", C.F.lit(1))).collect(), key=lambda r: (r["conv_id"], r["position"])):
        lines.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    assert all(hashlib.sha256("\n".join(lines.get(c, [])).encode()).hexdigest() == w[-1] for c, w in want.items())


@pytest.mark.parametrize("size", [1, 2, 5, 64])
def test_blocks_chain_to_the_whole(size):
    """Blocks solved from every state and chained by their tables give the audit of one pass."""
    rng = random.Random(size)
    for _ in range(80):
        turns = [(rng.choice("sssuuuaaat"), rng.choice([C.FINE, C.FINE, C.CUT, C.BLANK, C.DUPLICATE])) for _ in range(rng.randrange(1, 40))]
        whole = C.solve(turns, C.START)
        cost, s = C.last_state([w and w[:2] for w in whole])
        tables, texts = [], []
        for i in range(0, len(turns), size):
            ways = [C.solve(turns[i : i + size], s0)[t] for s0 in range(4) for t in range(4)]
            tables.append([w and w[:2] for w in ways])
            texts.append([w and w[2] for w in ways])
        total, picks = C.chained(tables)
        assert (total, "".join(t[k] for t, k in zip(texts, picks, strict=True)) + C.TAIL[picks[-1] % 4]) == (cost, whole[s][2] + C.TAIL[s])


def test_prefixes_compare_as_strings(monkeypatch):
    rng = random.Random(1)
    for prime in (C.PRIME, 5):  # with 5 most hashes collide
        monkeypatch.setattr(C, "PRIME", prime)
        nodes = C.Prefixes()
        made = [0]
        for _ in range(300):
            made.append(nodes.add(rng.choice(made), rng.choice(["D", "I", "K", "R", "IK"])))
        for a, b in (rng.sample(made, 2) for _ in range(2000)):
            x, y = nodes.text(a), nodes.text(b)
            assert (nodes.compare(a, b) > 0) == (x > y) and (nodes.compare(a, b) == 0) == (x == y)


def test_repair_of_odd_tables(spark):
    rows = [(None, None, None, None), (None, 2, "user", "Hi."), (1, None, "user", "b."), (1, None, "user", "a."), (1, 9, "assistant", "x" * 300_000 + "."), (2, 4, "user", "Hi."), (2, 4, "user", "Hi."), (2, 4, "user", "Hi."), (2, 7, "assistant", "Ho.")]
    frame = spark.createDataFrame(rows, TURNS)
    got = {r["conv_id"]: r for r in C.report(frame.withColumn("audit", C.F.lit("x"))).collect()}
    assert got[None]["blank"] == 1 and got[None]["audit"] == "DD" and got[None]["gaps"] == 0
    assert got[2]["duplicate"] == 2 and got[2]["audit"] == "KDDK" and got[2]["gaps"] == 2
    by_hash = sorted("ab", key=lambda t: hashlib.md5(f"{t}.".encode()).hexdigest())
    assert got[1]["illegal"] == 1 and got[1]["audit"] == "DKK" and got[1]["repaired_sha256"] == hashlib.sha256(f"user:{by_hash[1]}.\nassistant:{'x' * 300_000}.".encode()).hexdigest()
    assert C.report(frame.limit(0)).count() == 0
    gone = C.report(frame.limit(0), frame.select("conv_id")).collect()
    assert len(gone) == 3 and all(r["audit"] == "" and r["cost"] == 0 and r["repaired_sha256"] == hashlib.sha256(b"").hexdigest() for r in gone)


def test_damage(spark):
    rows = [(c, t, r, "Well. So!") for c in range(40) for t, r in ((0, "system"), (None, "user"), (2, None))]
    got = sorted(str(tuple(r)) for r in C.damaged(spark.createDataFrame(rows, TURNS)).collect())
    want = []
    for c, t, r, x in rows:
        k = zlib.crc32(f"{c}:{' ' if t is None else t}".encode()) % 20
        row = (c, t, "user" if k == 4 else r or " ", "" if k == 1 else "Well So" if k == 2 else x)
        want += [row] * (0 if k == 0 else 2 if k == 3 else 1)
    assert got == sorted(map(str, want))


def negatives_by_force(rows, anchor, positives=5, negatives=10):
    good = [(k, i, [math.floor(256 * x) for x in e], lab) for k, (i, e, lab) in enumerate(rows) if i is not None and lab is not None and e and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for k, i, e, lab in good:
        if not anchor(i):
            continue
        order = sorted(((-sum(x * y for x, y in zip(e, f, strict=True)), j, m, g) for m, j, f, g in good if m != k and len(f) == len(e)), key=lambda x: x[:3])
        for s, j, _, g in [x for x in order if x[3] == lab][:positives]:
            fit = [(n, -t) for t, n, _, h in order if h != lab and 30 * -s <= 100 * -t <= 90 * -s][:negatives]
            out += [(i, j, r + 1, n, -s, t) for r, (n, t) in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("scale", [1.0, 0.004])
def test_hard_negatives_equal_brute_force(spark, scale):
    rng = random.Random(7)
    rows = [(i, [rng.gauss(0.02, 0.3) * scale for _ in range(4)], rng.randrange(3)) for i in range(150)]
    rows += [(5, rows[5][1], 1), (200, None, 1), (201, [None, 1.0, 1.0, 1.0], 1), (202, [float("nan")] * 4, 1), (203, [1.0] * 4, None), (None, [1.0] * 4, 1), (204, [0.0] * 4, 0), (205, [0.5], 1), (206, [], 1), (207, [0.25], 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("row", H.F.lit(1))
    got = sorted(tuple(r) for r in H.hard_negatives(frame, H.F.expr("vec_id % 5 = 0")).collect())
    assert got == negatives_by_force(rows, lambda i: i % 5 == 0)
    assert H.hard_negatives(frame.limit(0), H.F.expr("true")).count() == 0


def test_scores_are_exact_or_held():
    big = [2.0**60, 1e200, -3.0]
    a = H.np.array([[max(-H.LONG, min(H.LONG, H.whole(x))) for x in big]])
    assert H.scores(a, a)[0, 0] == H.LONG and H.scores(a, -a)[0, 0] == -H.LONG
    b = H.np.array([[H.EXACT, 3, 5]])
    assert H.scores(b, b)[0, 0] == H.EXACT**2 + 34


def test_zero_scores_before_their_positive():
    pairs = sorted([(H.pack(1, 0, 0, 2, 2), False), (H.pack(1, 0, 0, 5, 5), True), (H.pack(1, 0, 0, 7, 7), False), (H.pack(1, 0, -3, 8, 8), False)])
    assert [r[1:4] for r in H.mined(iter(pairs))] == [(5, 1, 2), (5, 2, 7)]


def repeats_by_force(rows, n):
    """(doc_id, words, removed, kept) of each row, and the longest of n, 2n, 4n, ... that repeats."""
    texts = [(math.inf if d is None else d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    windows = lambda m: {(d, tuple(w[i : i + m])) for d, w in texts for i in range(len(w) - m + 1)}
    first, out = {}, []
    for d, w in windows(n):
        first[w] = min(first.get(w, math.inf), d)
    for (d, w), (doc_id, _) in zip(texts, rows, strict=True):
        gone = {j for i in range(len(w) - n + 1) if first[tuple(w[i : i + n])] < d for j in range(i, i + n)}
        longest, m = 0, n
        while any(d2 != d and (d2, tuple(w[i : i + m])) in held for held in [windows(m)] for i in range(len(w) - m + 1) for d2, _ in texts):
            longest, m = m, m * 2
        out.append((doc_id, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone), longest))
    return out


@pytest.mark.parametrize("n", [1, 5, 13])
def test_substring_removal_equals_brute_force(spark, n):
    rng = random.Random(n)
    passages = [[f"w{rng.randrange(400)}" for _ in range(rng.randrange(5, 60))] for _ in range(4)]
    rows = []
    for d in range(40):
        w = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(0, 50))]
        for p in rng.sample(passages, rng.randrange(0, 3)):
            k = rng.randrange(len(w) + 1)
            w[k:k] = p[rng.randrange(3) :]
        rows.append((d, rng.choice([" ", "\n", "\t\x0b "]).join(w)))
    same = " ".join(f"same{i % 7}" for i in range(70))
    rows += [(41, same), (41, same), (42, same + " é\x85ü"), (None, same), (None, same), (43, None), (44, ""), (45, " \n "), (41, "other " * 20), (50, "x"), (-3, "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("d", S.F.lit(1)).withColumn("at", S.F.lit(1))
    want = repeats_by_force(rows, n)
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in S.remove_repeats(frame, n).collect()), key=key) == sorted((r[:4] for r in want), key=key)
    if n == 13:
        assert sorted((tuple(r) for r in S.longest_repeats(frame, n).collect()), key=key) == sorted((r[::4] for r in want), key=key)
    assert S.remove_repeats(frame.limit(0), n).count() == 0 and (n > 1 or S.longest_repeats(frame.limit(0), n).count() == 0)


def test_substring_removal_of_a_very_long_text(spark):
    rng = random.Random(0)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(400_000))
    got = {r["doc_id"]: r for r in S.remove_repeats(spark.createDataFrame([(1, long), (2, "a b " + long[: len(long) // 2])], "doc_id long, text string")).collect()}
    assert got[1]["n_removed"] == 0 and got[1]["kept"] == long and got[2]["n_words"] - got[2]["n_removed"] in (2, 3)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
@pytest.mark.parametrize("name", ["op4_warc", "op8_jaccard_join", "op9_embedding_dedup", "op11_conversation_repair", "op12_substring_dedup", "op13_hard_negatives"])
def test_query_equals_its_sql(spark, name):
    import duckdb
    import pandas as pd

    import __spark_entry__ as entry
    from twinleg.llm.oracles import ORACLES

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    got, want = entry.queries()[name](spark, "/root/testdata/sf0.001").toPandas(), con.sql(ORACLES[name]).df()
    rows = lambda df: sorted(tuple("" if pd.isna(v) else str(int(v)) if isinstance(v, float) else str(v) for v in r) for r in df[sorted(want.columns)].astype(object).itertuples(index=False))
    assert rows(got) == rows(want)
