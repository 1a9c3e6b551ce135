"""Document archetypes, intended uses and context-source kinds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.functions.text import any_of, has_letter, lower_ascii, path_tokens, points, squash, strip, word_count
from quirelake.operators import parse

# The labels and headings that the rules look for.
PLANNING_LABELS = ("tone", "goal", "purpose", "result", "outcome", "stakes", "structure", "scope", "summary", "sequence")
PROFILE_LABELS = "role|background|history|trait|relationship|special|identity|profession|rank|dynamic|personality|mission|summary"
PROFILE_HEADINGS = ("relationships", "relationship", "background", "history", "personality", "professional identity", "professional summary", "identity", "mission", "dynamics")
NUMBERED = r"^([0-9]|(I|II|III|IV|V|VI|VII|VIII|IX|X)\.)"
ARCHETYPES = ("manuscript", "dossier_profile", "story_planning", "taxonomy_reference", "expository_world_article", "loose_note")
CANDIDATE_KINDS = ("entity_profile", "relationship", "timeline_event", "story_arc", "world_rule", "terminology", "extractive_summary")
FEATURES = ("n", "bullets", "labels", "numbered", "short", "long", "heading_like", "dashed", "planning", "profile", "profile_headings", "definitions")


def line_features(docs: DataFrame) -> DataFrame:
    """Counts of each kind of line (trimmed, not empty) per document, and of heading and paragraph spans, from one pass over the lines."""
    lines = parse.marked_lines(docs).select("path", "kind", "starts", strip(F.col("line")).alias("line")).where("line <> ''")
    line = F.col("line")
    words, chars, colon = word_count(line), F.length(line), F.instr(line, ":")
    left, right = F.expr("left(line, instr(line, ':') - 1)"), F.expr("substring(line, instr(line, ':') + 1)")
    label = (colon > 0) & word_count(left).between(1, 4) & right.rlike(r"[\p{IsAlphabetic}\p{N}]") & ~strip(left).startswith("#") & (chars <= 120)
    dashed = line.contains(" — ") | line.contains(" - ")
    heading = lower_ascii(strip(F.regexp_replace(line, "^[#:-]+|[#:-]+$", "")))
    capitals, letters = F.regexp_count(line, F.lit(r"\p{IsUppercase}")), F.regexp_count(line, F.lit(r"\p{IsAlphabetic}"))
    rules = {
        "n": F.lit(True),
        "bullets": line.rlike(r"^([-*+] |•)"),
        "labels": label,
        "numbered": line.rlike(NUMBERED),
        "short": chars <= 72,
        "long": chars >= 100,
        "heading_like": line.startswith("#") | line.rlike(NUMBERED) | (has_letter(line) & (words <= 12) & (chars <= 90) & (capitals * 2 >= letters)),
        "dashed": dashed & (words <= 12) & (chars <= 100),
        "planning": (colon > 0) & lower_ascii(strip(left)).isin(*PLANNING_LABELS),
        "profile": (colon > 0) & lower_ascii(left).rlike(PROFILE_LABELS),
        "profile_headings": heading.isin(*PROFILE_HEADINGS),
        "headings": F.col("kind") == "heading",
        "paragraphs": (F.col("kind") == "text") & F.col("starts"),
        "definitions": label | ((words <= 12) & (chars <= 120) & (line.contains(" = ") | dashed)),
    }
    counts = lines.groupBy("path").agg(*(F.count_if(rule).alias(k) for k, rule in rules.items()))
    out = docs.select("path", "document_type").join(counts, "path", "left")
    return out.na.fill(0, [*FEATURES, "headings", "paragraphs"])


def archetypes(docs: DataFrame) -> DataFrame:
    """path, document_type, archetype of path, text, document_type."""
    f = line_features(docs).withColumn("t", path_tokens(F.col("path")))
    c = {k: F.col(k) for k in (*FEATURES, "headings", "paragraphs")}
    t = F.col("t")
    planning = points(
        (any_of(t, "plan", "planning", "outline", "arc", "arcs", "beat", "beats"), 2), (c["planning"] >= 2, 3), (c["bullets"] >= 2, 1), (c["numbered"] >= 1, 1), (c["heading_like"] >= 2, 1), (c["short"] * 3 >= c["n"] * 2, 1)
    )
    dossier = (
        (c["profile"] >= 2)
        & ((c["labels"] >= 3) | (c["profile_headings"] >= 2))
        & (c["planning"] == 0)
        & ((c["dashed"] >= 1) | any_of(t, "profile", "profiles", "dossier", "character", "crew"))
        & (c["short"] * 2 >= c["n"])
    )
    taxonomy = points(
        (any_of(t, "glossary", "terminology", "taxonomy", "lexicon"), 2),
        (c["definitions"] >= 2, 2),
        (c["bullets"] >= 4, 2),
        (c["heading_like"] >= 2, 1),
        (c["long"] * 4 <= c["n"], 1),
        (c["short"] * 3 >= c["n"] * 2, 1),
        (c["profile"] == 0, 1),
        (c["profile_headings"] == 0, 1),
        (c["planning"] == 0, 1),
        (c["paragraphs"] <= 3, 1),
    )
    expository = points(
        (any_of(t, "history", "politics", "society", "culture", "world"), 2),
        ((c["headings"] >= 2) | (c["heading_like"] >= 2), 2),
        (c["paragraphs"] >= 4, 2),
        (c["long"] >= 2, 2),
        (c["bullets"] <= 2, 2),
        (c["long"] > c["bullets"], 1),
        (c["paragraphs"] > c["bullets"], 2),
    )
    reference = F.col("document_type") == "reference"
    kind = (
        F.when(F.col("document_type") == "manuscript", "manuscript")
        .when(planning >= 6, "story_planning")
        .when(reference & dossier, "dossier_profile")
        .when(reference & (taxonomy >= 6), "taxonomy_reference")
        .when(reference & (expository >= 6), "expository_world_article")
        .otherwise("loose_note")
    )
    return f.select("path", "document_type", kind.alias("archetype"))


def intended_use(archetype: Column, kind: Column) -> Column:
    working = (archetype == "loose_note") | ((archetype == "manuscript") & (kind == "extractive_summary")) | ((archetype == "dossier_profile") & (kind == "story_arc"))
    return F.when(archetype == "story_planning", "planning_only").when(working, "working_context").otherwise("canon_reference")


def source_kind(document_type: Column, path: Column, explicit: Column | None = None) -> Column:
    """'guide/prose', 'reference/timeline', 'note' or null, from the document type and its path's words."""
    t = path_tokens(path)
    has = lambda *w: any_of(t, *w)
    inferred = (
        F.when(has("prose") & has("guide", "guideline"), "guide/prose")
        .when(has("style") & has("guide", "sheet"), "guide/style")
        .when(has("critique") & has("guide", "rubric"), "guide/critique")
        .when(has("rewrite") & has("guide", "brief"), "guide/rewrite")
        .when(has("story") & has("summary", "synopsis"), "reference/story_summary")
        .when(has("world") & has("summary", "overview"), "reference/world_summary")
        .when(has("character", "characters") & has("bible", "sheet", "sheets", "guide", "notes"), "reference/character_bible")
        .when(has("timeline", "chronology"), "reference/timeline")
        .when(has("terminology", "glossary", "lexicon", "terms"), "reference/terminology")
        .when(has("research", "sourcebook"), "reference/research")
    )
    kind = F.when(document_type == "note", "note").when(document_type == "reference", inferred)
    return kind if explicit is None else F.coalesce(explicit, kind)


def context_sources(docs: DataFrame) -> DataFrame:
    """Sources of a project's typed documents; unclassified ones drop out."""
    kind = source_kind(F.col("document_type"), F.col("path"))
    return docs.select("path", kind.alias("kind"), F.lit("explicit_only").alias("activation_policy"), F.lit("user_authored").alias("review_state")).where("kind IS NOT NULL")
