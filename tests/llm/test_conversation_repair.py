"""Repairs against a plain search over all edit sequences."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from pointloom.llm.conversation_repair import Chart, Conversation, damaged, repair, repaired_turns

SCHEMA = "conv_id long, turn long, role string, text string, extra int"


def plain_damage(rows):
    out = []
    for conv, turn, role, text, *_ in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        code = zlib.crc32(key.encode()) % 20
        if code == 0:
            continue
        text = "" if code == 1 else text.translate({ord(c): None for c in ".!?"}) if code == 2 else text
        out += [(conv, turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    return out


def follow(state, letter):
    """The grammar's state after a role: n nothing, s system, u user, a assistant."""
    return {"ns": "s", "nu": "u", "su": "u", "au": "u", "ua": "a"}.get(state + letter)


def plain_repair(rows):
    """Least (cost, audit) by keeping every audit's full text for each state of the grammar."""
    seen, kinds = set(), []
    for _, _, role, text in rows:
        said = text.rstrip(" \t\n\x0b\x0c\r")
        kinds.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    states = {"n": (0, "", [])}

    def insert(states):
        for _ in range(4):
            for s, (cost, audit, lines) in list(states.items()):
                for r in "ua":
                    if (t := follow(s, r)) and (new := (cost + 2, audit + "I", lines + [{"u": "user:", "a": "assistant:"}[r]])) < states.get(t, (10**9, "", [])):
                        states[t] = new
        return states

    for (_, _, role, text), kind in zip(rows, kinds):
        new = {}
        for s, (cost, audit, lines) in insert(states).items():
            ways = [(s, cost + 3, audit + "D", lines)]
            if kind not in ("blank", "duplicate"):
                cost += kind == "truncated"
                ways += [(follow(s, role[:1]), cost, audit + "K", lines + [f"{role}:{text}"])] if role else []
                ways += [(follow(s, r[0]), cost + 2, audit + "R", lines + [f"{r}:{text}"]) for r in ("user", "assistant")]
            for t, *way in ways:
                if t and tuple(way) < new.get(t, (10**9, "", [])):
                    new[t] = tuple(way)
        states = new
    cost, audit, lines = min(v for k, v in insert(states).items() if k in "na")
    initials = [r[:1] for _, _, r, _ in rows]
    turns = [t for _, t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return (gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest), lines


def by_conversation(rows):
    out = {r[0]: [] for r in rows}
    for r in plain_damage(rows):
        out[r[0]].append(r)
    return {c: sorted(v, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3])) for c, v in out.items()}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    texts = ["Fine.", "Well?", "cut", " \t", "", None, "So\n", "Yes! ", "é", "Other."]
    out = []
    for conv in range(250):
        for turn in range(rng.choice([1, 1, 2, 5, 8])):
            out.append((conv, rng.choice([turn, turn, turn, turn + 3, None]), rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]), rng.choice(texts), 0))
    out += [(None, i, r, "Hm.", 1) for i, r in enumerate(["user", "user", "assistant"])]
    out += [(900, i, rng.choice(["user", "assistant"]), f"{i}" + "." * rng.randint(0, 1), 1) for i in range(3000)]
    return out


def test_against_plain_search(spark, rows):
    turns = damaged(spark.createDataFrame(rows, SCHEMA).repartition(7))
    found = {r[0]: tuple(r)[1:] for r in repair(turns).collect()}
    assert found == {c: plain_repair(v)[0] for c, v in by_conversation(rows).items()}


def test_repaired_turns_are_what_was_hashed(spark, rows):
    turns = damaged(spark.createDataFrame(rows, SCHEMA))
    found = repair(turns)
    lines = {}
    for r in repaired_turns(turns, found).orderBy("place").collect():
        lines.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    for conv, v in by_conversation(rows).items():
        assert lines.get(conv, []) == plain_repair(v)[1]


def test_columns_are_few_however_long_the_conversation():
    chart, rng = Chart(), random.Random(1)
    c = Conversation(chart)
    for i in range(20_000):
        c.add(i, rng.choice(["system", "user", "assistant", "x"]), rng.choice(["a", "a.", ""]), rng.random() < 0.1)
    assert len(c.result()["audit"]) >= 20_000 and len(chart.steps) < 2000


def test_empty_and_all_lost(spark):
    assert repair(damaged(spark.createDataFrame([], SCHEMA))).collect() == []
    lost = next((c, 0) for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    found = repair(damaged(spark.createDataFrame([(*lost, "user", "Hi.", 0)], SCHEMA))).first()
    assert tuple(found) == (lost[0], 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
