"""Draft changes: hunks are shortest differences, and rebuild either text; ranges follow their text."""

import random

import pytest
from pyspark.sql import functions as F

from quirelake.operators import drafts


def shortest(a, b):
    """Edits between two lists of lines, by the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return len(a) + len(b) - 2 * row[-1]


def lined(text):
    parts = text.split("\n")
    return [x + "\n" for x in parts[:-1]] + parts[-1:]


@pytest.mark.parametrize("most", [2_000, 3, 0])
def test_hunks_rebuild_both_texts_and_are_shortest(most):
    rng = random.Random(most)
    for _ in range(400):
        old = "\n".join(rng.choice("abcé") * rng.randrange(3) for _ in range(rng.randrange(12)))
        new = "\n".join(rng.choice("abcd") * rng.randrange(3) for _ in range(rng.randrange(12))) if rng.random() < 0.5 else old.replace("a", "a\nx", 1)
        hunks = list(drafts.hunks_of(old, new, most))
        at, made, lines = 0, "", lined(old)
        for start, stop, start_char, end_char, text in hunks:
            assert at <= start_char <= end_char <= len(old) and old[start_char:end_char] == "".join(lines[start:stop])
            made += old[at:start_char] + text
            at = end_char
        assert made + old[at:] == new and bool(hunks) == (old != new)
        if most > 100:
            taken = sum(stop - start for start, stop, *_ in hunks) + sum(len([x for x in lined(t) if x]) for *_, t in hunks)
            assert taken <= shortest(lined(old), lined(new)) + 1


def test_accepted_hunks_move_ranges_and_reach_into_some(spark):
    old, new = "one\ntwo\nthree\nfour\nfive", "zero\none\nTWO!\nthree\nfive\nsix"
    pairs = spark.createDataFrame([("a", old, new), ("b", old, old), ("c", None, "x"), ("d", "x", None)], "path string, old string, new string")
    hunks = drafts.diff(pairs)
    text = lambda some: {r.path: r.text for r in drafts.applied(pairs, some).collect()}
    assert text(hunks) == {"a": new, "b": old, "c": "x", "d": ""}
    assert text(hunks.limit(0)) == {"a": old, "b": old, "c": "", "d": "x"}
    assert text(hunks.where(F.col("new_text") == "zero\n"))["a"] == "zero\n" + old
    words = ["one", "two", "three", "four", "thr", "two\nthree", "ree\n", "one\n"]
    ranges = spark.createDataFrame([(p, w, old.index(w), old.index(w) + len(w)) for p in "ab" for w in words], "path string, word string, start_char long, end_char long")
    got = {(r.path, r.word): (r.new_start, r.new_end) for r in drafts.moved(ranges, hunks).collect()}
    for w in words:
        assert got["b", w] == (old.index(w), old.index(w) + len(w))
        gone = w in ("two", "four", "two\nthree")
        assert got["a", w] == ((None, None) if gone else (new.index(w), new.index(w) + len(w))), w
