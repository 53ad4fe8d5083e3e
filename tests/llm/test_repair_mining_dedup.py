"""Exact dedup, hard negatives and conversation repair against brute force, and odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.llm import conversations, exact_dedup, hard_negatives, queries
from tideline.llm.store import stored

SPACE = re.compile(r"[\x20\x09-\x0D]")
SF = "/root/testdata/sf0.001"


# --- exact dedup ----------------------------------------------------------------------------


def texts(n: int, seed: int) -> list[tuple]:
    r = random.Random(seed)
    base = [" ".join(r.choice("abcdé漢") * r.randrange(1, 4) for _ in range(r.randrange(0, 8))) for _ in range(n // 6)]
    spaced = lambda t: "".join(c + r.choice(["", "", " ", "\n", "\x0b\x0c"]) for c in t)
    return [(k, spaced(base[0] if r.random() < 0.33 else r.choice(base))) for k in range(n)]


def wanted(rows: list[tuple]) -> dict:
    groups = defaultdict(list)
    for k, t in rows:
        groups[SPACE.sub("", t or "")].append((-len(t or ""), k))
    out = {}
    for text, members in groups.items():
        keep = min(members)[1]
        out |= {k: (keep, len(members), k == keep, hashlib.sha256(text.encode()).hexdigest()) for _, k in members}
    return out


def test_exact_duplicates(spark):
    rows = texts(3000, 1)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(40)  # three rounds of a tree of 40 runs
    got = {r["doc_id"]: tuple(r)[1:] for r in exact_dedup.exact_duplicates(df).collect()}
    assert got == wanted(rows)


@pytest.mark.parametrize("parts", [1, 2, 16, 17])
def test_any_number_of_runs(spark, parts):
    rows = texts(200, parts)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    assert {r["doc_id"]: tuple(r)[1:] for r in exact_dedup.exact_duplicates(df).collect()} == wanted(rows)


def test_equal_digests_are_told_apart(spark):
    digests = stored(
        spark.createDataFrame([(k, 5, 7, bytearray([k % 2]) * 32, 5, k % 3, k) for k in range(12)], "doc_id long, n_chars int, digest long, sha binary, n_left int, run int, place long"), "digests"
    )
    rows = exact_dedup.tree_merged(digests).collect()
    assert sorted((r["best"]["doc_id"], r["size"]) for r in rows) == [(0, 6), (1, 6)]


def test_entries_of_a_hot_text(spark):
    """A text that is a third of all rows is one entry of each run before anything is exchanged."""
    df = spark.range(60_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("text")).repartition(8)
    digests = stored(exact_dedup._digests(df.withColumn("place", F.col("doc_id"))), "digests")
    runs = exact_dedup._merged(digests.select("run", *exact_dedup.KEY, F.struct("n_chars", "doc_id").alias("best"), F.lit(1).cast("long").alias("size")))
    per = runs.groupBy("run", *exact_dedup.KEY).count()
    assert per.agg(F.max("count")).first()[0] == 1
    assert runs.where("size > 1").count() == 8


def test_odd_documents(spark, odd, empty):
    rows = exact_dedup.exact_duplicates(odd).collect()
    assert len(rows) == odd.count()
    got = defaultdict(list)
    for r in rows:
        got[r["doc_id"]].append(r)
    assert [got[k][0]["keep_id"] for k in (4, 5, 6)] == [6, 6, 6]  # nothing but white space; the longest stays
    assert got[4][0]["text_sha256"] == hashlib.sha256(b"").hexdigest() and got[4][0]["group_size"] == 4
    assert got[1][0]["keep_id"] == 1 and got[1][0]["kept"] and got[1][0]["group_size"] == 2
    assert sorted(r["kept"] for r in got[10]) == [False, True] and got[10][0]["group_size"] == 2
    assert got[12][0]["kept"] and got[12][0]["group_size"] == 1
    assert exact_dedup.exact_duplicates(empty).count() == 0
    one = exact_dedup.one_of_each_text(odd)
    assert one.columns == odd.columns and one.count() == sum(r["kept"] for r in rows)
    assert exact_dedup.one_of_each_text(empty).count() == 0


# --- hard negatives -------------------------------------------------------------------------


def mined(rows: list[tuple], every: int, positives: int = 5, negatives: int = 10) -> list[tuple]:
    good = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in rows if None not in (i, v, lab) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (i, v, lab) in enumerate(good):
        if i % every:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w, strict=False)), j, k, other) for k, (j, w, other) in enumerate(good) if k != at]
        for s, j, _, _ in sorted(x for x in scored if x[3] == lab)[:positives]:
            fits = sorted(x for x in scored if x[3] != lab and 30 * -s <= 100 * -x[0] <= 90 * -s)[:negatives]
            out += [(i, j, n, x[1], -s, -x[0]) for n, x in enumerate(fits, 1)]
    return sorted(out)


def vectors(n: int, dims: int, seed: int, labels: int = 4) -> list[tuple]:
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, dims)) / math.sqrt(dims) + r.standard_normal((labels, dims))[np.arange(n) % labels] * 0.6
    return [(k, [float(y) for y in x[k]], k % labels) for k in range(n)]


VECTORS = "vec_id long, embedding array<double>, label int"


@pytest.mark.parametrize("n, dims", [(400, 3), (600, 24)])
def test_hard_negatives(spark, monkeypatch, n, dims):
    monkeypatch.setattr(hard_negatives, "WAVE", 13)  # several waves
    rows = vectors(n, dims, n)
    got = hard_negatives.hard_negatives(spark.createDataFrame(rows, VECTORS).repartition(5), F.col("vec_id") % 20 == 0)
    assert sorted(map(tuple, got.collect())) == mined(rows, 20)


@pytest.mark.parametrize("scale", [40, 1 << 20, 1 << 40])
@pytest.mark.parametrize("dims", [1, 2, 5, 64])
def test_walk_is_exact_and_stops(scale, dims):
    r = np.random.default_rng(dims)
    q = r.integers(-scale, scale, (2000, dims))
    q[100:400] = q[0]  # ties
    segment = hard_negatives.Segment(hard_negatives._segment(np.arange(2000), np.arange(2000) + 5, r.integers(0, 3, 2000), q).to_pylist()[0])
    scored = 0
    for a in [*q[:12], np.zeros(dims, np.int64)]:
        full = q.astype(object) @ a.astype(object)
        p = int(sorted(full)[-3])
        low, high = hard_negatives._windows([p, p // 2], 30, 90)
        found, fits = hard_negatives.Windows(10, low, high), segment.labels != 1
        scored += hard_negatives.walk(segment, a, fits, found)
        for k in range(2):
            assert found.best[k] == sorted((-int(full[i]), i, i + 5) for i in range(2000) if fits[i] and low[k] <= full[i] <= high[k])[:10]
    assert dims > 2 or scored < 13 * 2000  # lists of few dimensions are not read to their ends


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 1), (1, [0.9, 0.5], 1), (2, [0.5, 0.1], 2), (3, [0.5, 0.1], 2), (4, None, 1), (5, [nan, 1.0], 1), (6, [inf, 1.0], 2), (7, [None, 1.0], 2), (8, [1.0], None), (None, [1.0, 1.0], 2)]
    rows += [(9, [0.4], 2), (10, [], 2), (11, [0.6, 0.0, 3.0], 3), (12, [-1.0, -1.0], 1), (2, [0.5, 0.1], 2), (20, [0.0, 0.0], 1), (13, [0.0, 0.0], 2)]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], VECTORS + ", place int, anchor int, score int")
    got = hard_negatives.hard_negatives(df, F.col("vec_id") % 20 == 0)
    assert sorted(map(tuple, got.collect())) == mined(rows, 20)
    assert hard_negatives.hard_negatives(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert hard_negatives.hard_negatives(df, F.lit(False)).count() == 0


def test_immense_components(spark):
    rows = [(0, [3e6, 1.0], 1), (1, [2e6, 0.3], 1), (2, [1e6, 0.7], 2), (3, [1e6, 0.1], 2), (4, [1e300, 0.1], 2), (5, [1e6, 0.7], 3)]
    got = hard_negatives.hard_negatives(spark.createDataFrame(rows, VECTORS), F.col("vec_id") == 0)
    assert sorted(map(tuple, got.collect())) == mined(rows, 100)  # scores beyond 53 bits, told apart exactly; one beyond 64 is no negative


# --- conversations --------------------------------------------------------------------------


def hurt(rows: list[tuple]) -> list[tuple]:
    out = []
    for conv, turn, role, text in rows:
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        role = "user" if k == 4 else role
        out += [(conv, turn, role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def cheapest(rows: list[tuple]) -> tuple[int, str]:
    """(cost, audit) by trying all edits of the rows (role, fault) from each place and state, the last place first."""
    follow = {"": "u", "s": "u", "u": "a", "a": "u"}
    ahead: dict = {}
    for at in range(len(rows), -1, -1):
        now: dict = {}
        for inserted in (2, 1, 0):
            for state, to in follow.items():
                found = [(0, "")] if at == len(rows) and state in ("", "a") else []
                options = [(2, "I", now.get((to, inserted + 1)))] if inserted < 2 else []
                if at < len(rows):
                    role, fault = rows[at]
                    options.append((3, "D", ahead.get((state, 0))))
                    if fault not in ("blank", "duplicate"):
                        more = fault == "truncated"
                        options.append((2 + more, "R", ahead.get((to, 0))))
                        if role[:1] == to or (role[:1] == "s" and state == ""):
                            options.append((more, "K", ahead.get((role[:1], 0))))
                found += [(cost + rest[0], edit + rest[1]) for cost, edit, rest in options if rest]
                if found:
                    now[state, inserted] = min(found)
        ahead = now
    return ahead["", 0]


def report(rows: list[tuple], every: list) -> dict:
    out = {}
    for conv in every:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).hexdigest()))
        seen, faults = set(), []
        for _, _, role, text in own:
            left = SPACE.sub("", text)
            faults.append("blank" if not left else "duplicate" if (role, text) in seen else "truncated" if left[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = {r[1] for r in own} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        cost, audit = cheapest([(r[2], f) for r, f in zip(own, faults, strict=True)])
        lines, state, rest = [], "", iter(own)
        for edit in audit:
            _, _, role, text = (None, None, "", "") if edit == "I" else next(rest)
            if edit in "IR":
                role = "assistant" if state == "u" else "user"
            if edit != "D":
                lines.append(f"{role}:{text}")
                state = role[:1]
        out[conv] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


CONV = "conv_id long, turn long, role string, text string"


def chats(seed: int, n: int = 150) -> list[tuple]:
    r = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(r.randrange(1, 12)):
            role = r.choice(["user", "assistant"]) if r.random() < 0.3 else ["user", "assistant"][turn % 2]
            role = "system" if turn == 0 and r.random() < 0.4 or r.random() < 0.05 else role
            role = r.choice(["tool", "", None, "admin"]) if r.random() < 0.04 else role
            text = r.choice(["Yes.", "No!", "cut off", "", " \t", None, f"A text {r.randrange(9)}.", "trailing. \n"])
            rows.append((conv, None if r.random() < 0.03 else turn * r.choice([1, 1, 1, 2]), role, text))
    return rows


@pytest.mark.parametrize("chunk", [4096, 3])
def test_repair_report(spark, monkeypatch, chunk):
    """Also with conversations cut into chunks of three rows."""
    monkeypatch.setattr(conversations, "CHUNK", chunk)
    rows = [*chats(chunk), *((None, t, "user", f"x{t}") for t in range(7)), (900, 60, "user", "gone")]
    rows += [(800, k, "user" if k % 2 == 0 else "assistant", f"Long {k}.") for k in range(400)]
    df = spark.createDataFrame(rows, CONV).repartition(3)
    got = {r["conv_id"]: tuple(r)[1:] for r in conversations.repair_of_damaged(df).collect()}
    want = report(hurt(rows), sorted({r[0] for r in rows if r[0] is not None}) + [None])
    assert got == want


def test_conversations_of_the_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: tuple(r)[1:] for r in queries.op12_conversation_repair(spark, SF).collect()}
    assert got == report(hurt(rows), sorted({r[0] for r in rows}))


def test_repaired_rows(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hello."), (1, 2, "user", "And?"), (1, 3, "user", ""), (2, 0, "tool", "x."), (3, 0, "user", " ")]
    df = spark.createDataFrame([(*r, 5, 6) for r in rows], CONV + ", place int, edit int")
    got = [tuple(r) for r in conversations.repaired(df).orderBy("conv_id", "place").collect()]
    assert got[:5] == [(1, 0, "K", "system", "Be kind."), (1, 1, "I", "user", ""), (1, 2, "K", "assistant", "Hello."), (1, 3, "K", "user", "And?"), (1, 4, "I", "assistant", "")]
    assert {r[0] for r in got} == {1}  # deleting is cheaper for 2 and 3
    for f in (conversations.audited, conversations.repaired, conversations.repair_report, conversations.repair_of_damaged):
        assert f(df.limit(0)).count() == 0


def test_rules_have_the_matrix_of_their_symbols():
    r = random.Random(4)
    seqs = ["".join(r.choice("uaUAsx") for _ in range(r.randrange(1, 40))) for _ in range(60)]
    rules = ["ua", "xx", chr(0xE000) * 2, "Ua", chr(0xE002) + "u"]
    known, plain = conversations.matrices(rules), conversations.matrices([])
    spell = lambda m: [[x and (x[0], str(x[1])) for x in row] for row in m]
    for seq in seqs:
        short = conversations.rewritten(seq, rules)
        assert spell(conversations.product(short, known)) == spell(conversations.product(seq, plain))


def test_ropes_compare_like_texts():
    r = random.Random(5)
    ropes = [conversations.Rope("K")]
    for _ in range(300):
        ropes.append(r.choice(ropes) + r.choice([conversations.Rope(x) for x in ("", "K", "DK", "IR")] + ropes[-5:]) if len(str(ropes[-1])) < 400 else conversations.Rope("D"))
    for _ in range(2000):
        a, b = r.choice(ropes), r.choice(ropes)
        assert conversations.less(a, b) == (str(a) < str(b))


def test_a_long_conversation_is_many_chunks(spark):
    """A conversation that holds nearly all rows is dealt to all tasks until its chunks are folded."""
    n = 30_000
    df = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.col("id").cast("string"), F.lit(".")).alias("text"))
    (row,) = conversations.audited(df).collect()
    assert row["audit"] == "K" * n and row["cost"] == row["gaps"] == row["illegal"] == 0
