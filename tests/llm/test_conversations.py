"""Conversation repair against a search over all edit sequences, and its digests against plain code."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from defectflow.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string, lost boolean, seq long, edit string, audit string"
PAIRS = re.compile(r"(s?(ua)+)?")
WORD = re.compile(r"[^\x20\x09-\x0D]")


def judged(rows):
    """Damaged rows in order, each with its first fault."""
    seen, out = set(), []
    for turn, role, text in rows:
        letters = WORD.findall(text)
        kind = "blank" if not letters else "duplicate" if (role, text) in seen else "truncated" if letters[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((turn, role, text, kind))
    return out


def cheapest(rows):
    """By Dijkstra over (rows done, role initials so far); the first audit of least cost, ties least."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, roles, kept = heapq.heappop(heap)
        if i == len(rows) and PAIRS.fullmatch(roles):
            return cost, audit, "\n".join(kept)
        tail = roles[-1:] if len(roles) != 1 or roles != "s" else "S"
        if (i, tail) in done or not any(PAIRS.fullmatch(roles + more) for more in ("", "a", "ua", "uaua")):
            continue
        done.add((i, tail))
        for c, name in (("u", "user"), ("a", "assistant")):
            heapq.heappush(heap, (cost + 3, audit + "I", i, roles + c, (*kept, f"{name}:")))
        if i < len(rows):
            _, role, text, kind = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, roles, kept))
            if kind not in ("blank", "duplicate"):
                more = 3 * (kind == "truncated")
                heapq.heappush(heap, (cost + more, audit + "K", i + 1, roles + role[:1], (*kept, f"{role}:{text}")))
                for c, name in (("u", "user"), ("a", "assistant")):
                    heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, roles + c, (*kept, f"{name}:{text}")))
    raise AssertionError


def digest(rows):
    rows = judged(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])))
    turns = {t for t, *_ in rows if t is not None}
    kinds = [k for *_, k in rows]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    cost, audit, text = cheapest(rows)
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return gaps, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()


def damaged(rows):
    for conv, turn, role, text in rows:
        one = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{one(conv)}:{one(turn)}".encode()) % 20
        role, text = one(role), one(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        for _ in range(0 if kind == 0 else 2 if kind == 3 else 1):
            yield conv, turn, "user" if kind == 4 else role, text


def expected(rows, hurt=damaged):
    convs = {r[0]: [] for r in rows}
    for conv, *rest in hurt(rows):
        convs[conv].append(tuple(rest))
    return {(c, *digest(r)) for c, r in convs.items()}


def random_rows(seed, n):
    rng = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "u", "Assistant"]
    texts = ["Yes.", "No!", "What?  \n", "cut", " \t", "", None, "é.", "é", ". ", "Long. " * 40]
    convs = [None, *range(n)]
    return [(c, rng.choice([None, *range(6)]), rng.choice(roles), rng.choice(texts)) for c in convs for _ in range(rng.randint(1, 7))]


def test_damaged_and_repaired_as_by_search(spark, sf_dir):
    rows = random_rows(1, 150)
    frame = spark.createDataFrame([(*r, True, 1, "e", "a") for r in rows], SCHEMA)
    got = [tuple(r) for r in conversations.repair_report(conversations.damage(frame)).collect()]
    assert set(got) == expected(rows) and len(got) == 151
    assert conversations.repair_report(conversations.damage(frame.limit(0))).count() == 0


def test_registered_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = [tuple(r) for r in conversations.op12_conversations(spark, sf_dir).collect()]
    assert set(got) == expected(rows) and len(got) == len({r[0] for r in rows})


def test_giant_conversations_spill(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(1, t, rng.choice(["user", "assistant"]), rng.choice(["Fine.", "cut"]) + f" {t}.") for t in range(30_000)]
    kinds, later, backs = judged([r[1:] for r in rows]), None, conversations._Backlog()
    monkeypatch.setattr(conversations, "BLOCK", 10_000)
    later, _, end = conversations.step((0, 0, 0, 0), None, "")
    total = 0
    for turn, role, text, kind in reversed(kinds):
        later, least, choices = conversations.step(later, role[:1], kind)
        total += least
        backs.push((choices, str(turn), role, text, kind), len(text) + 100)
    assert len(backs.blocks) > 100
    edits = list(conversations._edits("1", backs, end))
    assert sum(e[3] for e in edits) == total + later[0]
    assert [e[5] for e in edits if e[2] != "I"] == [str(t) for t in range(30_000)]
    assert re.fullmatch("(ua)+", "".join(e[7][0] for e in edits if e[7]))
    (got,) = conversations.repair_report(spark.createDataFrame([(*r, False, 1, "e", "a") for r in rows], SCHEMA)).collect()
    assert (got["cost"], got["audit"]) == (total + later[0], "".join(e[2] for e in edits))


@pytest.mark.parametrize("seed", range(3))
def test_edit_rows_are_the_repaired_conversation(spark, seed):
    rows = random_rows(seed + 10, 30)
    got = conversations.repair(spark.createDataFrame([(*r, True, 1, "e", "a") for r in rows], SCHEMA)).collect()
    want = {r[0]: r for r in expected(rows, lambda rows: (tuple([c, t, *(" " if x is None else x for x in rest)]) for c, t, *rest in rows))}
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in got if r["conv_id"] == conv), key=lambda r: r["seq"])
        text = "\n".join(f"{r['role']}:{r['text']}" for r in mine if r["role"] is not None)
        assert (sum(r["cost"] for r in mine), "".join(r["edit"] for r in mine), hashlib.sha256(text.encode()).hexdigest()) == want[conv][6:]
