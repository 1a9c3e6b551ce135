"""Stated cases of the document operators: text, kinds, offsets and states."""

import random

import pytest

from pyspark.sql import functions as F

from quirelake.functions.ids import stable_id
from quirelake.operators import classify, context, extract, memory, parse, selection
from quirelake.plans import corpus
from quirelake.sources import files, projects, tree


def docs(spark, text, path="a.md", kind="reference"):
    return spark.createDataFrame([(path, text, kind)], "path string, text string, document_type string")


def spans(spark, text, **how):
    return parse.spans(docs(spark, text), **how).orderBy("ordinal").collect()


def test_headings_split_sections_and_share_one_scene(spark):
    text = "# Harbour\n\nBoats leave at noon.\n\n## Evening\n\nThey come home late.\n"
    assert [s.span_type for s in spans(spark, text)] == ["heading", "paragraph", "heading", "paragraph"]
    assert parse.sections(docs(spark, text)).count() == 2
    scene = parse.scenes(docs(spark, text)).collect()
    assert [(s.start_span_ordinal, s.end_span_ordinal) for s in scene] == [(0, 3)]


def test_byte_and_char_offsets_part_at_a_macron(spark):
    s = spans(spark, "# Lantern\n\nRō waits.\n")[1]
    assert (s.start_byte, s.end_byte, s.start_char, s.end_char) == (11, 21, 11, 20)
    whole = parse.sections(docs(spark, "# Lantern\n\nRō waits.\n")).first()
    assert (whole.start_byte, whole.end_byte, whole.start_char, whole.end_char, whole.start_line, whole.end_line) == (0, 21, 0, 20, 0, 2)


def test_scene_break_is_a_span_and_a_separator(spark):
    text = "The lamp went out.\n\n---\n\nMorning came grey.\n"
    assert [s.span_type for s in spans(spark, text)] == ["paragraph", "scene", "paragraph"]
    second = parse.scenes(docs(spark, text)).orderBy("ordinal").collect()[1]
    assert (second.separator, second.start_span_ordinal, second.end_span_ordinal) == ("---", 2, 2)


def test_short_follow_up_line_stays_in_its_paragraph(spark):
    found = spans(spark, "Salt covers every single step here.\nMind it.\n\n\nThe rail is new.\n\n")
    assert [s.text for s in found] == ["Salt covers every single step here.\nMind it.", "The rail is new."]


def test_sentence_lines_split_unless_strict(spark):
    text = "Gulls followed the barge all day.\nNobody threw them any bread at all.\nAt dusk they turned for the cliffs.\n"
    assert len(spans(spark, text)) == 3
    assert len(spans(spark, text, mode="strict_blank_lines")) == 1
    with pytest.raises(ValueError, match="unknown mode"):
        parse.spans(docs(spark, text), mode="loose")


def test_spaces_are_kept_in_text_and_squashed_beside_it(spark):
    s = spans(spark, "Rope\t tar   oil\n")[0]
    assert (s.text, s.normalized_text) == ("Rope\t tar   oil", "Rope tar oil")


@pytest.mark.parametrize("text", ["", "\n", "   \n\n"])
def test_blank_documents_have_no_spans(spark, text):
    assert spans(spark, text) == []


def test_null_text_and_empty_table(spark):
    assert spans(spark, None) == []
    none = docs(spark, "x").limit(0)
    assert parse.sections(none).count() == extract.entity_candidates(none).count() == classify.archetypes(none).count() == 0


def test_entities_join_forms_and_keep_their_order(spark):
    two = extract.entity_candidates(docs(spark, "The Copper Heron left with the ebb.\n\nCopper Heron was seen off the point.\n")).collect()
    assert [(r.name, r.anchors) for r in two] == [("Copper Heron", [0, 1])]


def test_single_sentence_starters_are_no_entities(spark):
    found = extract.entity_candidates(docs(spark, "Pilot Edda listened. Fog lay on the water.\n\nSomewhere a bell rang.\n")).collect()
    assert "Pilot Edda" in [r.name for r in found]
    assert "Somewhere" not in [r.name for r in found]


def test_facts_come_from_reference_documents_only(spark):
    text = "Pilot Edda: Keeper of the south light\n\nCopper Heron: Grain barge\n"
    rows = extract.reviewable_facts(docs(spark, text)).orderBy("ordinal").collect()
    assert [(r.subject, r.predicate, r.object) for r in rows] == [("Pilot Edda", "is", "Keeper of the south light"), ("Copper Heron", "is", "Grain barge")]
    assert extract.reviewable_facts(docs(spark, text, kind="manuscript")).count() == 0


def test_summaries_of_document_and_sections(spark):
    rows = extract.reviewable_summaries(docs(spark, "# North\n\nIce.\n\n# South\n\nSand.\n")).collect()
    assert sorted(r.scope for r in rows) == ["document", "section:0", "section:1"]
    assert extract.reviewable_summaries(docs(spark, "---\n\n")).count() == 0


def test_summary_stops_at_its_limit(spark):
    for n in (239, 240, 500):
        row = extract.reviewable_summaries(docs(spark, "x" * n + "\n")).first()
        assert len(row.text) == min(n, 240)


def test_empty_reference_is_a_taxonomy(spark):
    assert classify.archetypes(docs(spark, "", "x.md")).first().archetype == "taxonomy_reference"
    assert classify.archetypes(docs(spark, "Any.", kind="manuscript")).first().archetype == "manuscript"


def test_mappings_match_whole_path_parts(spark):
    paths = spark.createDataFrame([("src1/a.md",), ("src10/a.md",), ("lore/h.md",), ("top.txt",)], "path string")
    rules = spark.createDataFrame([("src1", "notes", True, 0), (".", "primary_manuscript", True, 1), ("lore", "reference", True, 2)], "path string, role string, enabled boolean, seq int")
    got = {r.path: r.document_type for r in files.classify_paths(paths, rules).collect()}
    assert got == {"src1/a.md": "note", "src10/a.md": "manuscript", "lore/h.md": "reference", "top.txt": None}


def test_only_approved_and_current_records_are_reusable(spark):
    log = [(1, "a", "p", "upsert"), (2, "a", "p", "approved"), (3, "b", "p", "upsert"), (4, "b", "p", "rejected"), (5, "c", "q", "upsert"), (6, "c", "q", "approved"), (7, "c", "q", "stale")]
    rows = memory.replay(spark.createDataFrame(log, "seq long, id string, path string, action string")).collect()
    assert {r.id for r in rows if r.reusable} == {"a"}


def test_saving_again_resets_the_review_unless_preserved(spark):
    saves = spark.createDataFrame([("a", 1, "approved", "old"), ("a", 2, "pending", "new")], "id string, seq long, review_state string, body string")
    assert [(r.body, r.review_state) for r in memory.upsert(saves).collect()] == [("new", "pending")]
    assert [(r.body, r.review_state) for r in memory.upsert(saves, preserve_review=True).collect()] == [("new", "approved")]


def test_context_takes_trusted_sources(spark):
    sources = [("p", "g.md", "guide/prose", "pinned", "approved"), ("p", "n.md", "note", "explicit_only", "user_authored"), ("p", "r.md", "reference/timeline", "pinned", "stale")]
    got = context.select_context(
        spark.createDataFrame([(1, "p", "editing")], "request_id int, project string, mode string"),
        spark.createDataFrame(sources, "project string, path string, kind string, activation_policy string, review_state string"),
        spark.createDataFrame([(1, "n.md"), (1, "r.md")], "request_id int, path string"),
    )
    assert {r.path for r in got.collect() if r.included} == {"g.md", "n.md"}


def test_read_tree_keeps_underscored_names(spark, tmp_path):
    made = {"chapters/one.md": "1\r\n1\r\n", "_drafts/two.md": "2", "_drafts/_old/three.md": "3", "notes/_n b+c.md": "4", "_top.md": "5", "_d[1]/_new.md": "6", "_metadata.md": "7", "_metadata_x/y.md": "10", "notes/n.md": "8", ".git/x.md": "9"}
    for path, text in made.items():
        (tmp_path / "root" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "root" / path).write_bytes(text.encode())
    want = sorted((p, t) for p, t in made.items() if not p.startswith("."))
    assert sorted((r.path, r.text) for r in tree.read_tree(spark, str(tmp_path / "root")).collect()) == want


def test_tree_flags_what_is_not_utf8(spark, tmp_path):
    (tmp_path / "bad.md").write_bytes(b"caf\xe9")
    (tmp_path / "good.md").write_bytes("café".encode())
    got = {r.path: (r.text, r.error_code) for r in tree.read_tree(spark, str(tmp_path)).collect()}
    assert got == {"bad.md": (None, "document_not_utf8"), "good.md": ("café", None)}


def test_stable_ids_equal_plain_big_numbers(spark):
    rows = [("notes/a.md", "Pilot Edda"), ("", ""), ("ü/😀.md", "x" * 300)]

    def plain(*parts):
        h = 0xCBF29CE484222325
        for byte in "\0".join(parts).encode():
            h = (h ^ byte) * 0x100000001B3 % (1 << 128)
        x = f"{h:032x}"
        return f"{x[:8]}-{x[8:12]}-{x[12:16]}-{x[16:20]}-{x[20:]}"

    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", stable_id(F.col("a"), F.col("b")).alias("id")).collect()
    assert [r.id for r in got] == [plain(r.a, r.b) for r in got]


def test_every_archetype_and_boundary_occurs(spark):
    folder = "/root/testdata/sf0.001"
    typed = corpus.typed(spark, folder)
    assert {r.archetype for r in classify.archetypes(typed).select("archetype").distinct().collect()} == set(classify.ARCHETYPES)
    assert {r.boundary_kind for r in parse.sections(typed).select("boundary_kind").distinct().collect()} == {"file_start", "heading", "scene_break"}


def test_letters_beyond_ascii_are_not_folded(spark):
    label = "Bac\u212aground: on the river"  # the Kelvin sign, which Unicode folds to k
    assert classify.line_features(docs(spark, label)).first().profile == 0
    assert classify.line_features(docs(spark, label.replace("\u212a", "K"))).first().profile == 1


def test_offsets_in_units_of_two_bytes(spark):
    text = spark.createDataFrame([("a😀bé",)], "t string")
    got = [text.select(selection.chars_before(F.col("t"), F.lit(n)).alias("c")).first().c for n in range(7)]
    assert got == [0, 1, 2, 2, 3, 4, 4]


MAPPINGS = "root_path string, seq int, path string, role string, enabled boolean"


def test_saving_replaces_a_project_whole_and_leaves_others(spark, tmp_path):
    store = str(tmp_path / "store")
    save = lambda *rows: {r.root_path: r.error_code for r in projects.save_config(spark.createDataFrame(list(rows), MAPPINGS), store).collect()}
    roots = spark.createDataFrame([("/a",), ("/b",), ("/none",)], "root_path string")
    read = lambda: [(r.root_path, r.seq, r.path, r.role, r.enabled, r.error_code) for r in projects.load_config(spark, store, roots).orderBy("root_path", "seq").collect()]
    assert save(("/a", 0, "./text/", "primary_manuscript", True), ("/a", 1, "lore", "reference", False), ("/b", 0, "all", "primary_manuscript", True)) == {"/a": None, "/b": None}
    assert save(("/a", 0, "new", "primary_manuscript", True), ("/a", 1, "unset", None, True), ("/b", 0, "../up", "primary_manuscript", True)) == {"/a": None, "/b": "unsafe_directory_path"}
    assert read() == [("/a", 0, "new", "primary_manuscript", True, None), ("/b", 0, "all", "primary_manuscript", True, None)]
    spark.createDataFrame([("odd", "harbour", True, "/b")], projects.SCHEMA).write.mode("append").partitionBy("root_path").parquet(store)
    assert ("/b", 1, "odd", "harbour", True, "invalid_stored_directory_role") in read()


def test_only_discovered_documents_of_open_projects_load(spark):
    config = spark.createDataFrame([("/a", 0, "text", "primary_manuscript", True, None), ("/b", 0, "x", "lost", True, "invalid_stored_directory_role")], MAPPINGS + ", error_code string")
    tree = spark.createDataFrame([("/a", "text/one.md", "# One\n\nSea.", None), ("/a", "other/two.md", "x", None), ("/a", "text/bad.md", None, "document_not_utf8"), ("/b", "x/y.md", "y", None)], "root_path string, path string, text string, error_code string")
    roots = spark.createDataFrame([("/a",), ("/b",), ("/c",)], "root_path string")
    opened = projects.open_projects(roots, config, tree)
    assert sorted((r.root_path, str(r.path), r.error_code or "") for r in opened.collect()) == [("/a", "text/bad.md", ""), ("/a", "text/one.md", ""), ("/b", "None", "invalid_stored_directory_role"), ("/c", "None", "not_configured")]
    asked = [("/a", "text/one.md"), ("/a", "other/two.md"), ("/a", "../text/one.md"), ("/a", "/text/one.md"), ("/a", "text/bad.md"), ("/b", "x/y.md"), ("/c", "z.md")]
    loaded = projects.load_documents(spark.createDataFrame(asked, "root_path string, path string"), opened, tree)
    got = {(r.root_path, r.path): (r.document_type, r.text, r.error_code) for r in loaded.collect()}
    assert got["/a", "text/one.md"] == ("manuscript", "# One\n\nSea.", None)
    assert [got[k][2] for k in asked[1:]] == ["document_not_discovered", "invalid_document_path", "invalid_document_path", "document_not_utf8", "invalid_stored_directory_role", "not_configured"]
    assert [(r.root_path, r.path, r.span_type) for r in projects.parsed(loaded).orderBy("ordinal").collect()] == [("/a", "text/one.md", "heading"), ("/a", "text/one.md", "paragraph")]


def test_paths_are_ordered_part_by_part(spark):
    rows = [("/a", p) for p in ("a-b/x.md", "a/b.md", "a.md", "a/b.md")]
    got = projects.in_order(spark.createDataFrame(rows, "root_path string, path string")).orderBy("position").collect()
    assert [r.path for r in got] == ["a/b.md", "a-b/x.md", "a.md"]


def test_stored_anchors_and_states(spark):
    anchors = spark.createDataFrame([([("span", 3), ("scene", 1)],)], f"a {memory.ANCHORS}")
    text = anchors.select(memory.encode_anchors(F.col("a")).alias("t"), memory.decode_anchors(memory.encode_anchors(F.col("a"))).alias("b"), "a").first()
    assert text.t == '[{"kind":"span","ordinal":3},{"kind":"scene","ordinal":1}]' and text.a == text.b


def test_a_request_takes_its_own_target_into_context(spark):
    row = context.new_requests(spark.createDataFrame([("editing", "own", "other")], "mode string, target string, context_target string")).first()
    assert (row.task_type, row.context_target, row.schema_version, len(row.request_id)) == ("rewrite_selection", "own", 1, 36)


def test_chat_messages_keep_their_order_and_threads_their_mode(spark):
    rows = [("t", 5, 1), ("t", 5, 0), ("t", 2, 9)]
    got = context.chat_log(spark.createDataFrame(rows, "thread_id string, created_at_ms long, seq long")).orderBy("position").collect()
    assert [r.seq for r in got] == [0, 1, 9] and len({r.message_id for r in got}) == 3
    threads = spark.createDataFrame([("t", "editing", "project"), ("u", "analysis", "project")], "thread_id string, mode string, scope string")
    moved = context.rescoped(threads, spark.createDataFrame([("t", "document", 1), ("t", "selection", 2)], "thread_id string, scope string, seq long"))
    assert sorted(tuple(r[c] for c in ("thread_id", "mode", "scope")) for r in moved.collect()) == [("t", "editing", "selection"), ("u", "analysis", "project")]


def test_no_target_after_an_empty_selection(spark):
    schema = "seq long, pane_id string, document_path string, selected_text string, start_char long, end_char long"
    rows = [(1, "p", "a.md", "word", 0, 4), (2, "q", "b.md", "", 0, 0)]
    assert selection.active_target(spark.createDataFrame(rows, schema)).count() == 0
    assert selection.active_target(spark.createDataFrame(rows[:1], schema)).first().pane_id == "p"


def test_intervals_meet_in_bins_once(spark):
    rng = random.Random(9)
    spans, at = [], 0
    for n in range(1500):
        size = rng.choice([1, 3, 40, 255, 256, 257, 2048, 2049, rng.randrange(1, 60_000)])
        spans.append((f"d{n % 3}.md", n, at, at + size))
        at += rng.choice([0, 1, size, size + rng.randrange(300)])
    spans += [("d0.md", 9000, 0, 1 << 40), ("e.md", 0, 5, 5)]
    sels = []
    for n in range(400):
        start = rng.choice([rng.randrange(-5, at), spans[rng.randrange(1500)][2]])
        sels.append((f"s{n}", rng.choice(["d0.md", "d1.md", "d2.md", "none.md", "e.md"]), start, start + rng.choice([0, -4, 1, 2, 256, rng.randrange(200_000)])))
    got = selection.overlap(spark.createDataFrame(sels, "sel_id string, path string, sel_start long, sel_end long"), spark.createDataFrame(spans, "path string, ordinal int, start_char long, end_char long")).collect()
    want = {i: sorted(o for p, o, s, e in spans if p == path and e > s and end > start and s < end and e > start) for i, path, start, end in sels}
    assert {r.sel_id: list(r.ordinals) for r in got} == want and len(got) == 400
    assert {r.sel_id: r.primary for r in got} == {i: o[0] if o else None for i, o in want.items()}


def test_a_document_of_many_spans_and_selections_is_joined_in_proportion(spark):
    n = 60_000
    spans = spark.range(n).selectExpr("'long.md' AS path", "cast(id AS int) AS ordinal", "id * 100 AS start_char", "id * 100 + 90 AS end_char")
    sels = spark.range(n).selectExpr("cast(id AS string) AS sel_id", "'long.md' AS path", "id * 100 + 50 AS sel_start", "id * 100 + 120 AS sel_end")
    found = selection.overlap(sels, spans)
    assert found.selectExpr("sum(size(ordinals)) AS n", "count(*) AS m").first() == (2 * n - 1, n)


LINES = ["# Head", "## Two", "", "", "   ", "---", "* * *", "One sentence that is long enough.", "Another sentence that is long enough.", "and it goes on", "Short one.", "“Quoted words that begin a line here.”", "no end", "x", "ü\U0001f600 wide, and rather long. ", "\r", "end.\r"]


@pytest.mark.parametrize("mode", ["conservative_heuristic", "strict_blank_lines"])
def test_documents_in_pieces_parse_as_whole_ones(spark, mode):
    rng = random.Random(21)
    rows = [(f"d{k}.md", "\n".join(rng.choice(LINES if k % 2 else LINES[6:15]) for _ in range(rng.randrange(60)))) for k in range(60)] + [("e.md", ""), ("n.md", None), ("t.md", "a\n\n"), ("h.md", "\n# x")]
    whole = spark.createDataFrame(rows, "path string, text string")
    columns = ["path", "ordinal", "span_type", "text", *parse.EXTENT]
    want = sorted(tuple(r) for r in parse.spans(whole, mode).select(*columns).collect())
    for lines in (1, 3, 1000):
        got = parse.spans_of(parse.marked_pieces(parse.pieces_of(whole, lines), mode)).select(*columns).collect()
        assert sorted(tuple(r) for r in got) == want


def test_a_large_file_is_parsed_by_several_tasks(spark, tmp_path):
    rng = random.Random(22)
    text = "\n".join(rng.choice(LINES) for _ in range(20_000)) + "\n"
    (tmp_path / "huge.md").write_bytes(text.encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        lines = parse.read_pieces(spark, str(tmp_path / "huge.md"))
        assert lines.select("chunk").distinct().count() > 3
        got = parse.spans_of(parse.marked_pieces(lines)).select("ordinal", "span_type", "text", *parse.EXTENT)
        want = parse.spans(docs(spark, text)).select("ordinal", "span_type", "text", *parse.EXTENT)
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and got.count() > 5_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
