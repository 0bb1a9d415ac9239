import pytest

from govspark.runtime import local_frame

#: Every operator must take these: null and empty texts, blanks only, repeated rows, null ids, columns with clashing names.
AWKWARD = [
    (1, None, "a", 0), (2, "", "a", 1), (3, " \t\n ", None, 2), (4, "one two three four five six", "b", 3), (4, "one two three four five six", "b", 3),
    (None, "a text without an id, of some words", "b", 4), (6, "x" * 30_000, "c", 5), (7, "la " * 9_000, "c", 6), (8, "naïve   Ünïcode 字字 \x1c\x85 ٣٤", None, None),
    (9, "One, two, three, four, five, six!", "a", 1),
]
SCHEMA = "doc_id long, text string, source string, {extra} long"


@pytest.fixture(scope="session")
def awkward(spark):
    """The awkward rows, with a last column of the given name."""
    return lambda extra="size": local_frame(spark, AWKWARD, SCHEMA.format(extra=extra)).select("doc_id", "text", "source", extra)


@pytest.fixture(scope="session")
def nothing(spark):
    return local_frame(spark, [], "doc_id long, text string, source string, lang string")
