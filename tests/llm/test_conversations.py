"""Conversation repair against a search over all edits, and damage against its definition."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from vigilspark.llm import conversations as c

SEPARATORS = " \t\n\x0b\x0c\r"


def slow_faults(rows):
    """(blank, duplicate, truncated) of each row of (role, text), at most one of them set."""
    seen, out = set(), []
    for role, text in rows:
        end = text.rstrip(SEPARATORS)
        blank = not end
        again = not blank and (role, text) in seen
        seen.add((role, text))
        out.append((blank, again, not blank and not again and end[-1] not in ".!?"))
    return out


def slow_repair(rows):
    """Cost, audit and repaired rows by a plain table of the best ways, forwards; a way is (cost, audit, rows)."""
    marks = slow_faults(rows)
    due = {"": "u", "s": "u", "u": "a", "a": "u"}
    ways = {"": (0, "", ())}
    for (role, text), (blank, again, cut) in itertools.chain(zip(rows, marks), [((None, None), (0, 0, 0))]):
        for _ in range(3):  # inserted rows before this one
            for state, (cost, audit, out) in list(ways.items()):
                put = (cost + 2, audit + "I", (*out, ("user" if due[state] == "u" else "assistant", "")))
                to = due[state]
                ways[to] = min(ways.get(to, put), put)
        if role is None:
            break
        new = defaultdict(list)
        for state, (cost, audit, out) in ways.items():
            new[state].append((cost + 3, audit + "D", out))
            if not blank and not again:
                to = role[:1]
                if to == due[state] or to == "s" and state == "":
                    new[to].append((cost + cut, audit + "K", (*out, (role, text))))
                new[due[state]].append((cost + 2 + cut, audit + "R", (*out, ("user" if due[state] == "u" else "assistant", text))))
        ways = {state: min(found) for state, found in new.items()}
    return min(ways[q] for q in ("", "a") if q in ways)


def every_audit(rows, most):
    """All edits up to ``most`` long, one by one."""
    marks = slow_faults(rows)
    found = []

    def go(i, state, cost, audit):
        if i == len(rows) and state in ("", "a"):
            found.append((cost, audit))
        if len(audit) == most:
            return
        due = "a" if state == "u" else "u"
        go(i, due, cost + 2, audit + "I")
        if i < len(rows):
            blank, again, cut = marks[i]
            go(i + 1, state, cost + 3, audit + "D")
            if not blank and not again:
                go(i + 1, due, cost + 2 + cut, audit + "R")
                first = rows[i][0][:1]
                if first == due or first == "s" and state == "":
                    go(i + 1, first, cost + cut, audit + "K")

    go(0, "", 0, "")
    return min(found)


def random_rows(r, n):
    return [(r.choice(["user", "assistant", "system", "user", "assistant", "tool", " "]), r.choice(["Yes.", "Is it?", "no end", "", " \n", "A.", "B!", "C"])) for _ in range(n)]


def codes(rows):
    return tuple((role[:1], blank or again, cut) for (role, _), (blank, again, cut) in zip(rows, slow_faults(rows)))


@pytest.mark.parametrize("seed", range(6))
def test_search_equals_all_edits(seed):
    r = random.Random(seed)
    for n in [0, 1, 2, 3, 3, 4] * 4:
        rows = random_rows(r, n)
        cost, audit = every_audit(rows, 6)
        assert (cost, audit) == slow_repair(rows)[:2] == c.repair_rows(codes(rows))


def test_search_equals_table_and_pieces():
    r = random.Random(9)
    for n in [5, 8, 13, 30, 80] * 12:
        rows = random_rows(r, n)
        want = slow_repair(rows)
        assert c.repair_rows(codes(rows)) == want[:2]
        state = {0: (0, "")}
        for i in range(0, n, 7):
            state = c._joined(state, c._piece_ways(codes(rows)[i:i + 7]))
        assert min(state[q] for q in (0, 3) if q in state) == want[:2]
        assert [x[1:] for x in c._edited(want[1], iter(rows))] == list(want[2])


def slow_query(table, damaged=True):
    conversations = defaultdict(list)
    for conv, turn, role, text in table:
        rows = conversations[conv]
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damaged else 9
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        rows.extend([(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1))
    out = set()
    for conv, rows in conversations.items():
        rows.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), hashlib.sha256(x[2].encode()).digest()))
        turns = {t for t, _, _ in rows if t is not None}
        plain = [x[1:] for x in rows]
        cost, audit, kept = slow_repair(plain)
        illegal = sum(a[:1] + b[:1] not in ("su", "ua", "au") for (a, _), (b, _) in zip(plain, plain[1:]))
        blank, again, cut = (sum(x) for x in zip(*slow_faults(plain))) if plain else (0, 0, 0)
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out.add((conv, gaps, blank, again, cut, illegal, cost, audit, hashlib.sha256("\n".join(f"{a}:{b}" for a, b in kept).encode()).hexdigest()))
    return out


SCHEMA = "conv_id long, turn long, role string, text string"


def awkward():
    r = random.Random(4)
    rows = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (2, None, "user", "One."), (2, 5, None, "Two"), (2, 9, "user", None), (3, 0, "system", "S.")]
    rows += [(None, t, role, text) for t, (role, text) in enumerate(random_rows(r, 150))]
    rows += [(7, t // 3, role, text) for t, (role, text) in enumerate(random_rows(r, 60))]
    rows += [(8, 4, "user", "Same.")] * 40 + [(9, None, None, None)] * 30 + [(10, 2, "", "No role."), (11, 1, "user", "x" * 200_000 + ".")]
    return rows + [(100 + k, t, role, text) for k in range(60) for t, (role, text) in enumerate(random_rows(r, r.randrange(1, 9)))]


@pytest.mark.parametrize("piece", [4, 512])
def test_repair_of_awkward_rows(spark, piece):
    rows = awkward()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert {tuple(x) for x in c.repair(df, piece=piece).collect()} == slow_query(rows, damaged=False)


def test_repaired_turns(spark):
    rows = [(1, 0, "system", "S."), (1, 1, "assistant", "Hm."), (1, 1, "assistant", "Hm."), (1, 2, "user", "So?"), (2, 0, "user", "Hi.")]
    got = sorted(map(tuple, c.repaired_turns(spark.createDataFrame(rows, SCHEMA)).collect()))
    want = slow_repair([x[2:] for x in rows[:4]])
    assert [x[3:] for x in got if x[0] == 1] == list(want[2])
    assert [x for x in got if x[0] == 2] == [(2, 0, "K", "user", "Hi."), (2, 1, "I", "assistant", "")]


def test_damage_and_query(spark, tmp_path):
    rows = awkward() + [(k, 0, "user", "Gone?") for k in range(2000, 2060)]
    extra = spark.createDataFrame([(*x, 1, "y") for x in rows], SCHEMA + ", cost int, audit string")
    extra.write.parquet(f"{tmp_path}/conversations.parquet")
    got = c.op11_conversation_repair(spark, str(tmp_path))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got = {tuple(x) for x in got.collect()}
    assert got == slow_query(rows)
    assert any(x[1:8] == (0, 0, 0, 0, 0, 0, "") for x in got)  # a conversation that was dropped whole
    extra.limit(0).write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert c.op11_conversation_repair(spark, f"{tmp_path}/none").collect() == []


def test_query_on_given_table(spark):
    from tests.conftest import SF

    rows = [tuple(x) for x in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert {tuple(x) for x in c.op11_conversation_repair(spark, SF).collect()} == slow_query(rows)
