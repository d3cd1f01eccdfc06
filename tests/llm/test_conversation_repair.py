"""Conversation repair against the cheapest of all edit sequences, over chunks of few rows."""

import hashlib
import heapq
import random
import re
import zlib
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from cohortframe.llm import conversation_repair as C

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"
NAMES = "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()


def cheapest(rows):
    """Least (cost, audit) over all edits, by search from the start; rows are (role, text, fault, initial)."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, built, lines = heapq.heappop(heap)
        if (i, built) in done:
            continue
        done.add((i, built))
        if i == len(rows) and re.fullmatch(r"(s?(ua)+)?", {"A": "ua", "U": "u", "SA": "sua", "SU": "su", "S": "s"}.get(built, built)):
            return cost, audit, list(lines)
        moves = []

        def go(initial):
            s, last = built.startswith("S"), built[-1:]
            if initial == "s":
                return "S" if not built else None
            if initial == "u":
                return ("S" if s else "") + "U" if last in ("", "S", "A") else None
            return ("S" if s else "") + "A" if initial == "a" and last == "U" else None

        for initial, role in (("u", "user"), ("a", "assistant")):
            if (to := go(initial)) is not None:
                moves.append((3, "I", i, to, f"{role}:"))
        if i < len(rows):
            role, text, fault, initial = rows[i]
            moves.append((4, "D", i + 1, built, None))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                if (to := go(initial)) is not None:
                    moves.append((more, "K", i + 1, to, f"{role}:{text}"))
                for x, new in (("u", "user"), ("a", "assistant")):
                    if (to := go(x)) is not None:
                        moves.append((3 + more, "R", i + 1, to, f"{new}:{text}"))
        for c, letter, j, to, line in moves:
            heapq.heappush(heap, (cost + c, audit + letter, j, to, lines + ((line,) if line is not None else ())))


def by_hand(rows):
    kept, every = [], set()
    for conv, turn, role, text in rows:
        every.add(conv)
        one = lambda x: " " if x is None else str(x)
        how = zlib.crc32(f"{one(conv)}:{one(turn)}".encode()) % 20
        role, text = one(role), one(text)
        if how == 0:
            continue
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        kept += [(conv, turn, "user" if how == 4 else role, text)] * (2 if how == 3 else 1)
    none = lambda x: (x is not None, x or 0)
    kept.sort(key=lambda r: (none(r[0]), none(r[1]), r[2], hashlib.sha256(r[3].encode()).digest()))
    out = {c: (c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in every}
    for conv, group in groupby(kept, key=lambda r: r[0]):
        seen, rows, n = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0, None: 0}
        group = list(group)
        for _, _, role, text in group:
            shown = text.strip("\x20\x09\x0a\x0b\x0c\x0d")
            fault = "blank" if not shown else "duplicate" if (role, text) in seen else None if shown[-1] in ".!?" else "truncated"
            seen.add((role, text))
            n[fault] += 1
            rows.append((role, text, fault, role[:1]))
        turns = [t for _, t, _, _ in group if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[3] + b[3] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        cost, audit, lines = cheapest(rows)
        out[conv] = (conv, gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return sorted(out.values(), key=repr)


def made(seed, conversations=60):
    rng = random.Random(seed)
    rows = []
    for conv in [*range(conversations), None]:
        for turn in range(rng.randint(1, 14)):
            role = rng.choice(["user", "assistant"] * 4 + ["system", "tool", "User", "", None])
            text = rng.choice(["Hello.", "Why? ", "no end", " \t\n", "", None, "é!", "x\x0b", "Wait.\x0c", " "]) if rng.random() < 0.5 else f"text {rng.random()}" + rng.choice([".", "", "?\n"])
            rows.append((conv, rng.choice([turn] * 6 + [None, turn + 7, -turn]), role, text))
    return rows + rows[3:6] + [(900, 1, "user", "same.")] * 9 + [(901, None, "system", "Only.")] + [(902, t, "system", f"All {t}.") for t in range(25)]


def found(df, **how):
    return sorted((tuple(r[n] for n in NAMES) for r in C.repair_digests(df, **how).collect()), key=repr)


@pytest.mark.parametrize("seed,how", [(1, {}), (2, {"chunk": 2}), (3, {"chunk": 3, "passes": 1})])
def test_against_all_sequences(spark, seed, how):
    rows = made(seed)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("edits", F.lit("clash")).withColumn("part", F.lit(1)).withColumn("copies", F.lit(7))
    assert found(df.repartition(5), **how) == by_hand(rows)


def test_given_conversations(spark):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").collect()]
    got = sorted((tuple(r[n] for n in NAMES) for r in C.op11_conversation_repair(spark, FOLDER).collect()), key=repr)
    assert got == by_hand(rows)


def test_repaired_rows(spark):
    """The rows themselves give the digests' texts, and follow the pattern."""
    df = spark.createDataFrame(made(4), SCHEMA)
    order = ["tail", "turn", "role_before", "digest", "place"]
    rows = C.repaired_rows(C.damaged(df), chunk=4).orderBy("conv_id", *order).collect()
    want = {r.conv_id: r for r in C.repair_digests(df).collect()}
    by_conv = {c: list(g) for c, g in groupby(rows, key=lambda r: r.conv_id)}
    for conv, r in want.items():
        own = by_conv.get(conv, [])
        assert hashlib.sha256("\n".join(f"{x.role}:{x.text}" for x in own).encode()).hexdigest() == r.repaired_sha256
        assert re.fullmatch("(s?(ua)+)?", "".join(x.role[0] for x in own))


def test_convergence(spark):
    """Alternating rows need no more than a pass; rows that never converge are closed by matrices; both cost the same as in one chunk."""
    rows = [(1, t, "user" if t % 2 else "assistant", f"{t}.") for t in range(400)] + [(2, t, "system", f"{t}.") for t in range(401)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(df, chunk=16, passes=2) == found(df, chunk=10_000)


def test_empty_and_long(spark):
    assert C.repair_digests(spark.createDataFrame([], SCHEMA)).count() == 0
    long = "word " * 400_000 + "."
    rows = [(1, 0, "user", long), (1, 2, "assistant", long + "!"), (1, 3, "assistant", long)]
    assert found(spark.createDataFrame(rows, SCHEMA)) == by_hand(rows)
