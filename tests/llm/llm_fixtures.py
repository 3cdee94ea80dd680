"""Hand-made frames: nulls, empty and long texts, ties, repeated rows, clashing column names."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, digest string, row int, batch string"
LONG = " ".join(["word", "Other", "third."] * 9000)


def documents(spark, rows):
    """Rows of (doc_id, text[, source]) with columns whose names operators use inside."""
    full = [(r[0], r[1], None, r[2] if len(r) > 2 else "s", len(r[1] or ""), 0.5, "x", 1, None) for r in rows]
    return spark.createDataFrame(full, DOCS)


def edge_rows():
    return [
        (1, "The same line here\nshort\n  THE SAME LINE here \nown line of one"),
        (2, None),
        (3, ""),
        (4, "\n\n"),
        (5, "the same line HERE\nÉcole du soir\nécole du soir"),
        (5, "the same line HERE\nÉcole du soir\nécole du soir"),
        (6, "one"),
        (None, "without an id\nthe same line here"),
        (None, None),
        (7, LONG + "\nthe same line here\n" + LONG),
        (8, "a" * 30_000),
        (9, " \t\x0b\x0c\r "),
        (10, "École du soir"),
    ]


def random_rows(seed, n=60):
    rng = random.Random(seed)
    lines = ["".join(rng.choice("abcd é") for _ in range(rng.randint(0, 14))) for _ in range(25)]
    return [(i * 3 + 1, "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 8)))) for i in range(n)]


def words(text):
    return (text or "").encode().lower().split()
