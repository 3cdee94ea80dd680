import random

import pytest

from aislecast.llm import rotation

SCHEMA = "conv_id long, turn long, role string, text string, part long, speaker int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA)


def brute(rows, per_part):
    talks = {}
    for c, t, r, x in rows:
        talks.setdefault(c, []).append((t is None, t or 0, r or "unknown", x or ""))
    out = []
    for c, turns in talks.items():
        turns.sort()
        for s in sorted({r for _, _, r, _ in turns if r != "system"}):
            start, parts = 0, [turns[i : i + per_part] for i in range(0, len(turns), per_part)]
            for k, part in enumerate(parts):
                text, mask = "", []
                for _, _, r, x in part:
                    name = "".join("_" if ch in "<|>= \t\n" else ch for ch in r)
                    text += "<|im_start|>" + ("system" if r == "system" else "assistant" if r == s else "user name=" + name) + "\n"
                    if r == s:
                        mask.append([len(text), len(text) + len(x)])
                    text += x + "<|im_end|>\n"
                out.append((c, s, k, len(parts), start, text, mask))
                start += len(text)
    return sorted(out, key=repr)


def long_rows():
    rng = random.Random(1)
    rows = [(1, i, rng.choice(["ann", "bob", "cy"]), "x" * rng.randint(0, 9)) for i in range(700)]
    return rows + [(2, 5000 - i * 3, rng.choice(["user", "assistant", "system"]), "é😀") for i in range(90)]


EDGE = [(1, 0, "user", None), (1, 0, "user", None), (1, None, "", "late"), (1, 2, None, "two"), (2, 0, "system", "only"), (None, 1, "a b", "x"), (None, 0, "user", "y"), (3, 0, "x<|y=z", "")]


@pytest.mark.parametrize("per_part", [1, 4, 64])
@pytest.mark.parametrize("rows", [EDGE, long_rows(), []])
def test_against_brute_force(spark, rows, per_part):
    got = rotation.rotate(frame(spark, rows), per_part).collect()
    assert sorted(((*r[:-1], [list(m) for m in r.mask]) for r in map(lambda r: r, got)), key=repr) == brute(rows, per_part)
