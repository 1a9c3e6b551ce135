"""Names in spans: found within a span's own row."""

from quirelake.operators import extract

SCHEMA = "path string, ordinal int, span_type string, normalized_text string, start_char long, end_char long"


def test_mentions_are_found_without_an_exchange(spark):
    texts = ["The A", "The Old Man", "x Y Z", '"Ann" Bee, (Cee) d Eve', "... Q", "Éa É 9X X9", "none here", ""]
    spans = spark.createDataFrame([("p", k, "paragraph", t, 0, len(t)) for k, t in enumerate(texts)], SCHEMA)
    found = extract.mentions(spans)
    got = sorted((r.ordinal, r.start, r.name) for r in found.collect())
    assert got == [(1, 0, "Old Man"), (2, 1, "Y Z"), (3, 0, "Ann Bee Cee"), (3, 4, "Eve"), (4, 1, "Q"), (5, 0, "Éa É"), (5, 3, "X9")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not [name for name in ("Exchange", "Window", "Sort") if name in plan]
