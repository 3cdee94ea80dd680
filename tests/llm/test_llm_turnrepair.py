"""Conversation repair against brute force over all edits, in one piece and in many."""

import hashlib
import itertools
import random

import pytest
from llm_fixtures import LONG
from pyspark.sql import functions as F

from aislecast.llm import turnrepair
from aislecast.llm.turnrepair import Stacks, damaged, pieces, repair, summaries

TURNS = "conv_id long, turn long, role string, text string, cost long, rows int, audit string"
BLANK = " \t\n\x0b\x0c\r"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, 1, "x") for r in rows], TURNS)


def faults(rows):
    """(initial, fault) of each row in order."""
    seen, out = set(), []
    for _, role, text in rows:
        core = text.rstrip(BLANK)
        out.append((role[:1], "blank" if not core else "duplicate" if (role, text) in seen else "" if core[-1] in ".!?" else "truncated"))
        seen.add((role, text))
    return out


def cheapest(marked):
    """Least (cost, audit) by a search over all edits with the regular form of the grammar."""
    goto = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    best = {"": (0, "")}

    def inserted(states):
        out = dict(states)
        for _ in range(4):
            for state, (c, a) in list(out.items()):
                for t in "ua":
                    if t in goto[state]:
                        new = (c + 3, a + "I")
                        if goto[state][t] not in out or new < out[goto[state][t]]:
                            out[goto[state][t]] = new
        return out

    for initial, fault in marked:
        after = {}

        def offer(state, new):
            if state not in after or new < after[state]:
                after[state] = new  # noqa: B023

        for state, (c, a) in best.items():
            offer(state, (c + 4, a + "D"))
        if fault not in ("blank", "duplicate"):
            more = 3 if fault == "truncated" else 0
            for state, (c, a) in inserted(best).items():
                if initial in goto[state]:
                    offer(goto[state][initial], (c + more, a + "K"))
                for t in "ua":
                    if t != initial and t in goto[state]:
                        offer(goto[state][t], (c + 3 + more, a + "R"))
        best = after
    return min(v for s, v in inserted(best).items() if s in ("", "a"))


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    marked = faults(rows)
    cost, audit = cheapest(marked)
    out, at = [], 0
    for e in audit:
        role, text = (rows[at][1], rows[at][2]) if e != "I" else ("", "")
        at += e != "I"
        if e != "D":
            out.append((e, role, text))
    lead = bool(out) and out[0][0] == "K" and out[0][1][:1] == "s"
    lines = [f"{role if e == 'K' else ('user', 'assistant')[(n - lead) % 2]}:{text}" for n, (e, role, text) in enumerate(out)]
    turns = [r[0] for r in rows if r[0] is not None]
    count = {f: sum(x == f for _, x in marked) for f in ("blank", "duplicate", "truncated")}
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *count.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def result(spark, rows, ids=None):
    turns = frame(spark, rows)
    out = summaries(repair(turns), turns if ids is None else ids)
    return {r[0]: tuple(r[1:]) for r in out.collect()}


def random_rows(seed, conversations=60, longest=14):
    rng = random.Random(seed)
    texts = ["", " \t", "One.", "Two!", "Three?", "cut off", "a b ", "One. \n", "x" * 30 + "."]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", " ", "s"]
    rows = []
    for c in range(conversations):
        for t in range(rng.randint(1, longest)):
            rows.append((c if c else None, rng.choice([t, t, t, None, t // 2]), rng.choice(roles), rng.choice(texts)))
    return rows


@pytest.mark.parametrize("seed,piece", [(1, 256), (2, 256), (3, 2), (4, 3)])
def test_repair_equals_brute_force(spark, monkeypatch, seed, piece):
    monkeypatch.setattr(turnrepair, "PIECE", piece)
    rows = random_rows(seed)
    got = result(spark, rows)
    by = {}
    for c, *r in rows:
        by.setdefault(c, []).append(r)
    assert got.keys() == by.keys()
    for c, r in by.items():
        assert got[c] == brute(r), (c, r)


def test_every_short_sequence_of_initials():
    parser = Stacks()
    kinds = [("u", ""), ("a", ""), ("s", ""), ("x", "truncated"), ("u", "truncated"), ("a", "blank")]
    for n in range(5):
        for marked in itertools.product(kinds, repeat=n):
            turns = [(i, f == "blank", f == "truncated") for i, f in marked]
            ends = parser.parse({parser.root: (0, "")}, turns)
            got = min((c + 3 * parser.tails[t], a + "I" * parser.tails[t]) for t, (c, a) in ends.items() if parser.tails[t] is not None)
            assert got == cheapest(marked), marked


def test_a_long_conversation_is_many_pieces(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], f"Turn {t}." if t % 50 else "cut") for t in range(1500)] + [(2, 0, "user", LONG)]
    rows += [(1, 1500, "user", "Again.")] * 400
    cut = pieces(frame(spark, rows))
    assert cut.count() >= 6 and cut.agg(F.max(F.size("rows"))).first()[0] <= turnrepair.PIECE
    got = result(spark, rows)
    assert got[1] == brute([r[1:] for r in rows if r[0] == 1])
    assert got[2] == brute([(0, "user", LONG)])


def test_nothing_left_and_nothing_at_all(spark):
    ids = spark.createDataFrame([(1,), (None,), (1,), (8,)], "conv_id long")
    got = result(spark, [(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes.")], ids)
    none = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got == {1: (0, 0, 0, 0, 0, 0, "KK", hashlib.sha256(b"user:Hi.\nassistant:Yes.").hexdigest()), None: none, 8: none}
    assert result(spark, []) == {}


def test_nulls_are_one_space_and_copies_are_damaged_alike(spark):
    rows = [(None, None, None, None), (5, 3, "user", "A!"), (5, 3, "user", "A!"), (6, 0, "system", None)]
    import zlib

    want = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind:
            one = (c, t, "user" if kind == 4 else role, "" if kind == 1 else text.translate({ord(x): None for x in ".!?"}) if kind == 2 else text)
            want += [one] * (2 if kind == 3 else 1)
    assert sorted(map(repr, (tuple(r) for r in damaged(frame(spark, rows)).collect()))) == sorted(map(repr, want))
