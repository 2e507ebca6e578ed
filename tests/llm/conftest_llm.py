"""Rows that every operator must stand."""

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
EDGES = [
    (1, None, None, None),
    (2, "", "en", "a"),
    (3, "  \t\n ", "en", None),
    (None, "a row without an id, but with words", None, "a"),
    (4, "word " * 30_000, "en", "a"),
    (5, "The same text twice, long enough to be compared as one line.", "en", "b"),
    (5, "The same text twice, long enough to be compared as one line.", "en", "b"),
    (6, "the same TEXT twice, long enough to be compared as one line.", "en", "b"),
    (7, "ÄÖÜ    字符 😀 \x1c x", "de", "b"),
]
