"""Rows and helpers that the tests of this folder share."""

import random


def odd_rows():
    """Nulls, empties, white space, repeated rows, ties, one very long text, many alike."""
    rng = random.Random(7)
    words = ["alpha", "beta", "gamma", "the", "of", "ünï", "x1"]
    base = " ".join(rng.choices(words, k=120))
    long_line = " ".join(rng.choices(words, k=30))
    rows = [
        (None, None), (None, base), (1, None), (2, ""), (2, ""), (3, " \t\n\x0b\r "), (4, base), (4, base), (5, base),
        (6, base + " end"), (7, "\n".join([long_line] * 4)), (8, long_line + "\n\n  " + long_line.upper() + "\nshort"),
        (9, long_line), (10, long_line + "\r\n" + base), (11, " ".join(rng.choices(words, k=20_000))), (12, "a" * 5000),
        (13, "one two three"), (14, "one two three"), (15, base.replace("alpha", "omega", 1)), (15, "other text of the same id"),
        (-3, base[:200]), (16, "😀" * 60 + " é" * 40),
    ]
    return rows + [(100 + i, base + f" {i}") for i in range(30)]


def plain(rows):
    return sorted((tuple(r) for r in rows), key=repr)
