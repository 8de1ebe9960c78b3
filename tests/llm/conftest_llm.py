"""Shared rows and helpers of these tests."""

#: Nulls, empty and blank texts, repeats in text and row, ties, a null id, very long texts.
AWKWARD = [
    (1, None), (2, ""), (3, "a  b\n\tc d"), (4, "a b c d"), (5, "A b c d"), (5, "A b c d"), (None, "a b c d"), (None, None),
    (7, "\t \n"), (8, "wort " * 40_000), (9, "wort " * 40_000), (10, "é ü 日本 <|endoftext|>"), (11, "x" * 100_000), (12, "."),
]


def rows_of(rows, *names):
    found = [tuple(r[n] for n in names) if len(names) > 1 else r[names[0]] for r in rows]
    return sorted(found, key=lambda x: (x is None, x) if not isinstance(x, tuple) else str(x))
