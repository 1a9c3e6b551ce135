"""Project-like corpora derived from the shared tables, and small fixed inventories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.concat("source", F.lit("/doc_"), "doc_id", F.lit(".md")).alias("path"), "text")


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One Markdown document per conversation, a scene break before every third turn."""
    c = table(spark, sf_dir, "conversations")
    turn = F.concat(F.when(F.col("turn") % 3 == 2, "---\n\n").otherwise(""), "role", F.lit(": "), "text")
    turns = F.array_sort(F.collect_list(F.struct("turn", turn.alias("body"))))
    text = F.concat(F.lit("# Conversation "), "conv_id", F.lit("\n\n"), F.array_join(F.transform(turns, lambda t: t.body), "\n\n"), F.lit("\n"))
    return c.groupBy("conv_id").agg(turns.alias("turns")).select(
        F.concat(F.lit("transcript/conv_"), "conv_id", F.lit(".md")).alias("path"),
        F.concat(F.lit("# Conversation "), "conv_id", F.lit("\n\n"), F.array_join(F.transform("turns", lambda t: t.body), "\n\n"), F.lit("\n")).alias("text"),
        F.lit("note").alias("document_type"),
    )


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One reference document per nation: its region and its customers' segments."""
    n, r, c = (table(spark, sf_dir, x) for x in ("nation", "region", "customer"))
    held = c.select(F.col("c_nationkey").alias("n_nationkey"), "c_mktsegment").distinct()
    lines = F.array_sort(F.collect_list(F.concat(F.lit("Balance holders - "), "c_mktsegment")))
    own = held.groupBy("n_nationkey").agg(F.array_join(lines, "\n").alias("lines"))
    rows = n.join(r, n.n_regionkey == r.r_regionkey).join(own, "n_nationkey")
    text = F.concat(F.lit("## "), "n_name", F.lit("\n\n- Region: "), "r_name", F.lit("\n"), "lines", F.lit("\n"))
    return rows.select(F.concat(F.lit("reference/"), "n_name", F.lit(".md")).alias("path"), text.alias("text"), F.lit("reference").alias("document_type"))


LONG = "The keepers of @ wrote that the tides were measured twice a day for as long as anyone in the harbour could remember."
#: One shape of document for each class: folder, type and lines; @ stands for a supplier's name.
SHAPES = [
    ("planning/arc_", "note", ["Goal: bring @ across the strait", "Stakes: the winter stores", "1. Set out", "2. Turn back", "- ropes", "- lamps"]),
    ("crew/profile_", "reference", ["Role: buyer at @", "Background: raised on barges", "Trait: patient", "Mission - keep the ledgers dry"]),
    ("world/history_", "reference", [LONG, "", "# Early years", "", LONG, "", LONG, "", "# Later years", "", LONG, "", LONG]),
    ("chapters/part_", "manuscript", ["@ stood at the rail before the first bell.", "", "---", "", "## Landing", "", "Nobody spoke until the rope was fast."]),
    ("misc/scraps_", "reference", ["Goal: ask @", "what they said of the role of this: little", "- nets", "- oars", "- tar"]),
]


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per supplier, in turn of each shape."""
    s, n = table(spark, sf_dir, "supplier"), F.col("s_suppkey") % len(SHAPES) + 1
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), n.cast("int"))
    return s.select(
        F.concat(pick([d for d, _, _ in SHAPES]), "s_suppkey", F.lit(".md")).alias("path"),
        F.replace(pick(["\n".join(lines) + "\n" for _, _, lines in SHAPES]), F.lit("@"), F.col("s_name")).alias("text"),
        pick([k for _, k, _ in SHAPES]).alias("document_type"),
    )


def typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts(spark, sf_dir).unionByName(references(spark, sf_dir)).unionByName(shapes(spark, sf_dir))


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of projects: one project per source, with documents, notes and files that no one reads."""
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id") % 9
    names = ["chapters/part_", "chapters/old/part_", "lore/a-b_", "lore/a/b_", "notes/n_", "notes/.cache/n_", "_drafts/d_", "top_", "img/p_"]
    ends = [".md", ".MD", ".md", ".markdown", ".txt", ".md", ".mdown", ".txt", ".png"]
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (k + 1).cast("int"))
    return d.select(F.concat(F.lit("/home/"), "source").alias("root_path"), F.concat(pick(names), "doc_id", pick(ends)).alias("path"), "text", F.lit(None).cast("string").alias("error_code"))


#: Mappings of every project; those whose number ends in 7 have none.
CONFIG = [(0, "./chapters/", "primary_manuscript", True), (1, "lore", "reference", True), (2, "notes", "notes", True), (3, "chapters/old", "ignore", True), (4, "_drafts", "notes", False), (5, "unset", None, True)]
#: One more mapping, which keeps a project from being saved, by the last figure of its number.
WRONG = [(4, "  ", "notes"), (5, "lore/", "notes"), (6, "../up", "notes"), (8, "second", "primary_manuscript")]


#: Role mappings: sources 0-9 manuscript, 10-14 reference, 15-18 notes, 19 ignored; a nested override and a disabled row.
MAPPINGS = (
    [(f"src{k}", "primary_manuscript", True) for k in range(10)]
    + [(f"src{k}", "reference", True) for k in range(10, 15)]
    + [(f"src{k}", "notes", True) for k in range(15, 19)]
    + [("src19", "ignore", True), ("src1/doc_1.md", "notes", True), ("src2", "ignore", False)]
)
#: Directories as a user may write them, for two projects.
DRAFTS = [
    ("a", " drafts/ ", "primary_manuscript", True), ("a", "./lore//maps", "reference", True), ("a", ".", "notes", True),
    ("b", "drafts", "primary_manuscript", True), ("b", "drafts/", "reference", True), ("b", "notes", None, True),
    ("c", "../outside", "primary_manuscript", True), ("c", "/tmp/x", "notes", True), ("c", "   ", "ignore", False),
    ("d", "one", "primary_manuscript", True), ("d", "two", "primary_manuscript", True), ("d", "three", "primary_manuscript", False),
    ("e", "lore", "reference", True), ("e", "bits", "ignore", False),
]
#: Texts in the place of stored anchors, and what they hold (None: they are wrong).
ANCHOR_TEXTS = [
    ("[{", None), ("", None), ("null", None), ("{}", None), ("[null]", None), ("[{}]", None), ('[{"kind":"span"}]', None), ('[{"ordinal":1}]', None), ('[{"kind":"nonsense","ordinal":1}]', None),
    ('[{"kind":"span","ordinal":-1}]', None), ('[{"kind":"span","ordinal":1.5}]', None), ('[{"kind":"span","ordinal":1.0}]', None), ('[{"kind":"span","ordinal":1e2}]', None), ('[{"kind":"span","ordinal":"1"}]', None),
    ('[{"kind":"span","ordinal":true}]', None), ('[{"kind":1,"ordinal":1}]', None), ('[{"kind":"Span","ordinal":1}]', None), ('[{"kind":"span","ordinal":1}] x', None), ('[{"kind":"span","ordinal":1}]]', None), ('[{"kind":"span","ordinal":1}]}', None),
    ('[],[]', None), ('[{"kind":"span","ordinal":1,"kind":"scene"}]', None), ('[{"kind":"span","ordinal":01}]', None), ('[{"kind":"span","ordinal":1},]', None), ('[["span"]]', None), ('[["span",1,2]]', None), ('[{"kind":"span","ordinal":1},null]', None),
    ("[]", ""), (" [ ] ", ""), ('[{"ordinal":7,"kind":"window"},{"kind":"section","ordinal":0}]', "window 7,section 0"), ('[{"kind":"span","ordinal":3,"note":{"kind":[1]}}]', "span 3"), ('[["scene",2]]', "scene 2"), ('[{"kind":"span","ordinal":9007199254740993}]', "span 9007199254740993"),
]
#: Files of a made-up project.
FILES = [
    "readme.md", "cover.png", "chapters/1. Start.MD", "chapters/art/a.png", "notes/todo.txt", "notes/.git/x.md", "world_context/map.png",
    "world_context/lore/deep.markdown", "lore/history.md", "lore/.md", "empty/x.bin", ".hidden/y.md", "Notes/z.mdown", "_drafts/w.txt",
]
#: Paths whose words name kinds of context sources.
SOURCES = [
    ("guides/prose guide.md", "reference"), ("guides/prose.md", "reference"), ("style-sheet.md", "reference"), ("critique_rubric.md", "reference"), ("rewrite/brief.md", "reference"),
    ("story/synopsis.md", "reference"), ("World Overview.md", "reference"), ("characters/notes.md", "reference"), ("lore/Timeline.md", "reference"), ("Glossary.md", "reference"),
    ("terms.txt", "reference"), ("sourcebook/a.md", "reference"), ("lore/misc.md", "reference"), ("story summary.md", "note"), ("ideas.md", "note"), ("prose guideline.md", "manuscript"),
]
