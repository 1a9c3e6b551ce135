"""Relationships, timelines and contradictions against plain versions."""

import itertools
import math
import random
from collections import Counter

import pytest

from quirelake.operators import relations


@pytest.mark.parametrize(("reach", "least"), [(0, 1), (1, 2), (3, 2)])
def test_related_names_are_counted_once_for_each_pair_of_places(spark, reach, least):
    rng = random.Random(reach)
    rows = [(f"d{rng.randrange(4)}", rng.randrange(30), rng.choice(["Ada", "ada", "Édo", "Bo", "Cy", "Di", "Ed"])) for _ in range(260)] + [("d0", k, "Ada") for k in range(30)]
    places = sorted({(p, o, n.lower()) for p, o, n in rows})
    count = Counter(n for *_, n in places)
    pairs = Counter(tuple(sorted((a[2], b[2]))) for a, b in itertools.combinations(places, 2) if a[0] == b[0] and a[2] != b[2] and abs(a[1] - b[1]) <= reach)
    want = {(*k, n, math.floor(math.log(n * 120.0 / (count[k[0]] * count[k[1]])) * 1000)) for k, n in pairs.items() if n >= least}
    got = relations.related(spark.createDataFrame(rows, "path string, ordinal int, name string").repartition(3), 120, reach, least).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_dates_are_put_in_the_order_of_time(spark):
    texts = ["In March 1895, not 30 February 1895, she left; on 7 March 1895 (or March 7, 1895) it snowed.", "1895-03-06 was fair. 1895-3-06, 11895-03-06 and 1895-13-01 are none. April 1894-5", None, "7 Mars 1895, 07 March 0999, January 1, 1000; éMarch 1895"]
    rows = spark.createDataFrame([("a", n, t) for n, t in enumerate(texts)] + [("b", 0, "May 2001")], "path string, ordinal int, text string")
    got = [(r.path, r.position, r.ordinal, r.nth, r.said, str(r.day), r.precision) for r in relations.timeline(rows).orderBy("path", "position").collect()]
    assert got == [
        ("a", 0, 3, 0, "07 March 0999", "0999-03-07", "day"), ("a", 1, 3, 1, "January 1, 1000", "1000-01-01", "day"), ("a", 2, 0, 0, "March 1895", "1895-03-01", "month"),
        ("a", 3, 1, 0, "1895-03-06", "1895-03-06", "day"), ("a", 4, 0, 2, "7 March 1895", "1895-03-07", "day"), ("a", 5, 0, 3, "March 7, 1895", "1895-03-07", "day"), ("b", 0, 0, 0, "May 2001", "2001-05-01", "month"),
    ]


def test_classes_follow_long_chains(spark):
    rng = random.Random(8)
    names = [f"n{k:03}" for k in range(200)]
    order = rng.sample(names, 200)
    pairs = list(itertools.pairwise(order[:120])) + [(order[150], order[151]), (order[151], order[151]), (order[160], order[160]), (None, order[0]), *[(order[170], x) for x in order[171:]]]
    got = {r["name"]: r.least for r in relations.classes(spark.createDataFrame(pairs, "a string, b string")).collect()}
    want = {n: min(group) for group in (order[:120], order[150:152], [order[160]], order[170:]) for n in group}
    assert got == want


def test_contradictions_need_two_documents_and_two_objects(spark):
    facts = [
        ("a.md", 0, "Heron", "is", "Grain barge"), ("b.md", 1, "the Copper  Heron", "is", "ferry"), ("c.md", 0, "HERON", "is", "grain  BARGE"),
        ("a.md", 2, "Edda", "is", "pilot"), ("a.md", 3, "Edda", "is", "keeper"), ("b.md", 2, "Lo", "is", "cook"), ("c.md", 2, "Lo", "is", "Cook"), ("d.md", 0, "Lo", "was", "x"), ("d.md", 1, None, "is", "x"), ("e.md", 1, "Ve", "is", ""),
    ]
    names = spark.createDataFrame([("heron", "Copper Heron"), ("The Copper Heron", "copper heron")], "a string, b string")
    got = relations.contradictions(spark.createDataFrame(facts, "path string, ordinal int, subject string, predicate string, object string"), names).collect()
    assert {(r.entity, r.path, r.ordinal) for r in got} == {("copper heron", "a.md", 0), ("copper heron", "b.md", 1), ("copper heron", "c.md", 0)} and len(got) == 3
    none = spark.createDataFrame([], "a string, b string")
    assert relations.contradictions(spark.createDataFrame(facts, "path string, ordinal int, subject string, predicate string, object string"), none).count() == 0
