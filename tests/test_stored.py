"""Trees, stored anchors, the memory store and the staleness stream."""

import os

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from quirelake.operators import memory
from quirelake.plans import corpus
from quirelake.sources import files, memory_store, projects, tree
from quirelake.streaming import staleness


def put(root, made):
    for path, data in made.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(data)


@pytest.mark.parametrize(("parts", "splits"), [(1, 1), (3, 2), (64, 1), (64, 3)])
def test_trees_are_read_whole_however_they_are_dealt(spark, tmp_path, parts, splits):
    root = tmp_path / "root"
    made = {"a.md": b"one", "empty.md": b"", "x/empty/none.txt": b"", "_m/_n/o p+q%20.md": "é\r\n".encode(), "bad.txt": b"\xff\xfe", "x=1/_metadata/y.md": b"y", "weiß/[1]*?.md": b"z"}
    made |= {f"deep/{'d/' * k}f{k}.md": str(k).encode() for k in range(9)} | {f"flat/{k}.md": b"." * k for k in range(40)}
    made[f"x{root}/y.md"] = b"a long name that repeats the root's"
    put(root, made | {".git/x.md": b"no", "x/.y.md": b"no", "deep/.d/z/a.md": b"no"})
    (root / "nothing/below").mkdir(parents=True)
    os.symlink(root / "deep", root / "deep/d/again")
    os.symlink(root / "flat", root / "linked")
    want = {p: d for p, d in made.items()} | {f"linked/{k}.md": b"." * k for k in range(40)}
    got = tree.read_tree(spark, str(root), parts, splits).collect()
    assert sorted(r.path for r in got) == sorted(want)
    assert {r.path: r.text for r in got} == {p: None if p == "bad.txt" else d.decode() for p, d in want.items()}
    assert [r.path for r in got if r.error_code] == ["bad.txt"]


def test_no_tree_holds_nothing(spark, tmp_path):
    put(tmp_path, {"file.md": b"x"})
    for root in (tmp_path / "missing", tmp_path / "file.md"):
        assert tree.read_tree(spark, str(root)).count() == 0
    assert tree.read_tree(spark, f"file://{tmp_path}").count() == 1


def test_written_trees_stay_below_their_root(spark, tmp_path):
    rows = spark.createDataFrame([("a/b.md", bytearray(b"x")), ("c.md", None)], "path string, content binary")
    assert tree.write_tree(rows, str(tmp_path / "t")) == 2
    assert sorted((r.path, r.text) for r in tree.read_tree(spark, str(tmp_path / "t")).collect()) == [("a/b.md", "x"), ("c.md", "")]
    with pytest.raises(Exception, match="not below the root"):
        tree.write_tree(spark.createDataFrame([("../b.md", "x")], "path string, content string"), str(tmp_path / "t"))


def test_only_whole_lists_of_anchors_are_read(spark):
    rows = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(corpus.ANCHOR_TEXTS)] + [(99, None)], "k int, t string")
    got = {r.k: r.a for r in rows.select("k", memory.decode_anchors(F.col("t")).alias("a")).collect()}
    said = {k: None if a is None else ",".join(f"{x.kind} {x.ordinal}" for x in a) for k, a in got.items()}
    assert said == {k: held for k, (_, held) in enumerate(corpus.ANCHOR_TEXTS)} | {99: None}


def test_paths_are_judged_by_their_parts(spark):
    told = {"c/x.md": True, "c//x.md": True, "c/x.md/": True, "c/./x.md": True, "./c/x.md": False, ".": False, "": False, "/c": False, "c/../x": False, "..": False, "c/..x": True, ".c/x": True, None: False}
    rows = spark.createDataFrame([(p,) for p in told], "path string").select("path", projects.safe_path(F.col("path")).alias("safe"))
    assert {r.path: r.safe for r in rows.collect()} == told


def test_saved_mappings_meet_the_scanned_ones_in_order(spark):
    scanned = spark.createDataFrame([("p", "notes", "notes", 1), ("p", "bin", "ignore", 0), ("q", "lore", None, 5)], "project string, path string, suggested_role string, seq int")
    saved = spark.createDataFrame([("p", "notes", "reference", False), ("p", "beta", "notes", True), ("p", "Alpha", "notes", True), ("q", "notes", "ignore", True)], "project string, path string, role string, enabled boolean")
    rows = files.merge_mappings(scanned, saved, by=("project",)).orderBy("project", "position").collect()
    assert [tuple(r) for r in rows] == [
        ("p", "bin", "ignore", False, True, 0), ("p", "notes", "reference", False, True, 1), ("p", "Alpha", "notes", True, False, 2), ("p", "beta", "notes", True, False, 3),
        ("q", "lore", None, True, True, 0), ("q", "notes", "ignore", True, False, 1),
    ]


def test_lists_keep_the_place_of_the_first_save(spark):
    log = [(1, "b", "p", "upsert"), (2, "a", "p", "upsert"), (3, "b", "q", "upsert"), (4, "b", "q", "approved")]
    rows = memory.list_records(memory.replay(spark.createDataFrame(log, "seq long, id string, path string, action string"))).collect()
    assert [(r.id, r.source_document_path, r.review_state) for r in rows] == [("b", "q", "approved"), ("a", "p", "pending")]


def fact(id_, seq, path="a.md", review="pending", anchors='[{"kind":"span","ordinal":1}]', name="s"):
    return (id_, seq, name, "is", "o", path, anchors, 0, 5, review, "current")


FACTS = "id string, seq long, subject string, predicate string, object string, source_document_path string, source_anchors_json string, source_start_char long, source_end_char long, review_state string, staleness_state string"


def test_a_store_keeps_every_kind_of_record(spark, tmp_path):
    store, kind = str(tmp_path / "store"), "reviewable_facts"
    read = lambda name="all": [(r.id, r.subject, r.review_state, r.staleness_state) for r in memory_store.listed(spark, store, kind, name).collect()]
    save = lambda *rows: memory_store.save(spark.createDataFrame(list(rows), FACTS), store, kind)
    review = lambda *rows: {r.id: r.error_code for r in memory_store.review(spark.createDataFrame(list(rows), "id string, review_state string, seq int"), store, kind).collect()}
    stale = lambda *paths: memory_store.mark_stale(spark.createDataFrame([(p,) for p in paths], "path string"), store)
    assert read() == [] and stale("a.md") == dict.fromkeys(memory_store.KINDS, 0)
    save(fact("y", 2), fact("x", 1), fact("z", 3, "b.md", anchors="[7]"), fact("x", 4, name="later"))
    assert read() == [("x", "later", "pending", "current"), ("y", "s", "pending", "current"), ("z", "s", "pending", "current")]
    assert review(("y", "rejected", 1), ("y", "approved", 2), ("nobody", "approved", 1)) == {"y": None, "nobody": "memory_record_not_found"}
    assert read("reusable") == [("y", "s", "approved", "current")]
    assert stale("a.md", "c.md", "a.md") == {"entity_candidates": 0, "reviewable_facts": 2, "reviewable_summaries": 0}
    assert read("reusable") == [] and [r[0] for r in read("stale")] == ["x", "y"] and [r[0] for r in read("approved")] == ["y"]
    assert stale("a.md")["reviewable_facts"] == 2
    save(fact("y", 0, name="anew"))
    assert read() == [("x", "later", "pending", "stale"), ("y", "anew", "pending", "current"), ("z", "s", "pending", "current")]
    errors = {r.id: (r.error_code, r.anchors and [tuple(a) for a in r.anchors]) for r in memory_store.listed(spark, store, kind).collect()}
    assert errors["z"] == ("invalid_stored_anchors", None) and errors["y"] == (None, [("span", 1)])
    with pytest.raises(ValueError, match="unknown kind"):
        memory_store.listed(spark, store, "facts")


def test_changes_make_records_stale_once_and_restarts_repeat_nothing(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "state"))

    def turn(*rows):
        for row in rows:
            spark.createDataFrame(list(row), staleness.EVENTS).coalesce(1).write.mode("append").parquet(source)
        staleness.stale_records(spark, source, out, checkpoint, files_per_batch=1)
        return sorted(tuple(r) for r in spark.read.schema(staleness.STALE).parquet(out).collect())

    first = [("a", 1, None, "x"), ("a", 2, "r1", None), ("a", 2, "r2", None), ("b", 1, None, ""), ("b", 2, "r3", None), (None, 1, None, "x")]
    assert turn(first) == []
    one = turn([("a", 3, None, "x"), ("b", 3, None, None)], [("a", 4, None, "z"), ("a", 4, None, "z")])
    assert one == [("r1", "a", 4, "changed"), ("r2", "a", 4, "changed"), ("r3", "b", 3, "deleted")]
    assert turn() == one
    two = turn([("a", 5, "r1", None), ("a", 3, None, "old"), ("b", 2, "late", None)], [("a", 6, None, "zz"), ("b", 4, None, "")])
    assert two == sorted([*one, ("late", "b", 3, "deleted"), ("r1", "a", 6, "changed")])


def test_a_batch_reads_and_writes_the_state_once_for_many_paths():
    calls = []

    class Value:
        held = None

        def exists(self):
            calls.append("exists")
            return self.held is not None

        def get(self):
            calls.append("get")
            return self.held

        def update(self, value):
            calls.append("update")
            self.held = value

    class Places:
        def getValueState(self, *_):  # noqa: N802
            return Value()

    watch = staleness.Watch()
    watch.init(Places())
    event = lambda path, seq, id_=None, digest=None: Row(path=path, seq=seq, id=id_, digest=digest)
    turn = lambda *rows: sorted((r.path, r.id, r.seq, r.change) for r in watch.handleInputRows((0,), iter(rows), None))
    assert turn(*(event(p, 1, digest="x") for p in "abc"), *(event(p, 2, f"r{k}") for k in range(50) for p in "ab")) == [] and calls == ["get", "update"]
    assert turn(event("b", 3, digest="y"), event("a", 3, digest="x")) == [("b", f"r{k}", 3, "changed") for k in sorted(range(50), key=str)] and calls == ["get", "update"] * 2
    assert turn(event("b", 3, digest="y")) == [] and calls == [*["get", "update"] * 2, "get"]
    assert turn(event("b", 2, "late"), event("b", 4, "r1"), event("c", 4, "r2")) == [("b", "late", 3, "changed")]
    assert turn(event("b", 5), event("c", 5)) == [("b", "r1", 5, "deleted"), ("c", "r2", 5, "deleted")]
