"""Conversation repair against brute force over all edits."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from functools import cache

import pytest

from tests.llm.fixtures import clashing
from tipweave.llm import repair
from tipweave.llm.queries import talks

ROWS = "conv_id bigint, turn bigint, role string, text string"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        what = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if what == 0:
            continue
        text = "" if what == 1 else re.sub("[.!?]", "", text) if what == 2 else text
        out += [(conv, turn, "user" if what == 4 else role, text)] * (2 if what == 3 else 1)
    return out


def brute(rows):
    """Per conversation what the query returns, by a search over all edits, front to back."""
    found = {conv: None for conv, *_ in rows}
    for conv in found:
        own = [r[1:] for r in damaged(rows) if r[0] == conv]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        faults, seen = [], set()
        for _, role, text in own:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen
                          else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))

        def add(found, cost, letter, *said):
            return found[0] + cost, letter + found[1], said + found[2]

        @cache
        def whole(i, state, made=0):
            ways = []
            onward = {"": "u", "s": "u", "u": "a", "a": "u"}[state]
            name = {"u": "user", "a": "assistant"}[onward]
            if i == len(own):
                if state in ("", "a"):
                    ways.append((0, "", ()))
            else:
                _, role, text = own[i]
                more = int(faults[i] == "truncated")
                ways.append(add(whole(i + 1, state), 3, "D"))
                if faults[i] in ("", "truncated"):
                    if role[:1] == onward or (state == "" and role[:1] == "s"):
                        ways.append(add(whole(i + 1, role[0]), more, "K", f"{role}:{text}"))
                    ways.append(add(whole(i + 1, onward), 2 + more, "R", f"{name}:{text}"))
            if made < 3:
                ways.append(add(whole(i, onward, made + 1), 2, "I", f"{name}:"))
            return min(ways) if ways else (10**9, "~", ())

        cost, audit, said = whole(0, "")
        numbers = [t for t, *_ in own if t is not None]
        initials = [r[:1] for _, r, _ in own]
        found[conv] = (
            max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0,
            *(faults.count(x) for x in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
            cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest(),
        )
    return found


def odd_talks(seed=5, convs=60):
    rng = random.Random(seed)
    rows = []
    for conv in range(convs):
        for turn in range(rng.randrange(9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "uncle", None])
            text = rng.choice(["Yes.", "No", " \n", "", "Why? ", None, f"Turn {turn}.", "ä 漢字!"])
            rows.append((conv, rng.choice([turn, turn, turn, None, 3]), role, text))
    rows += [(None, t, "user", f"no id {t}.") for t in range(3)]
    rows += [(777, 1, "user", "word " * 50_000 + "."), (777, 2, "assistant", "ok.")]
    rows += [(778, 4, "user", "Same.")] * 3
    return rows


def got(spark, monkeypatch, rows):
    df = clashing(spark.createDataFrame(rows, ROWS))
    monkeypatch.setattr(talks, "table", lambda *a: df)
    columns = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    return {r.conv_id: tuple(r[c] for c in columns) for r in talks.repaired(spark, "").collect()}


@pytest.mark.parametrize("block", [128, 2])
def test_against_all_edits(spark, monkeypatch, block):
    monkeypatch.setattr(repair, "LEAST_BLOCK", block)
    rows = odd_talks()
    assert got(spark, monkeypatch, rows) == brute(rows)


def test_one_long_conversation_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(repair, "LEAST_BLOCK", 7)
    rng = random.Random(1)
    rows = [(1, t, rng.choice(["user", "assistant"]), rng.choice(["a.", "b", f"c{t}.", ""]))
            for t in range(150)]
    assert got(spark, monkeypatch, rows) == brute(rows)


def test_nothing(spark, monkeypatch):
    assert got(spark, monkeypatch, []) == {}
    gone = next((c, 0, "user", "x.") for c in range(99) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    empty = hashlib.sha256(b"").hexdigest()
    assert got(spark, monkeypatch, [gone]) == {gone[0]: (0, 0, 0, 0, 0, 0, "", empty)}


def test_repaired_turns_keep_their_texts(spark):
    rows = [(1, 0, "system", "Be."), (1, 1, "assistant", "Hi."), (1, 2, "user", ""), (1, 3, "user", "Q?")]
    turns, tallies = repair.repaired(spark.createDataFrame(rows, ROWS))
    said = [(r.edit, r.turn, r.role, r.text) for r in turns.orderBy("block", "at").collect()]
    audit = tallies.first().audit
    assert [e for e, *_ in said] == [e for e in audit if e != "D"]
    assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for _, _, r, _ in said))
    assert {t for e, n, _, t in said if e != "I"} <= {"Be.", "Hi.", "Q?"}
