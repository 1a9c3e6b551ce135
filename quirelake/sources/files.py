"""Project files: role mappings, discovery and import candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelake.functions.text import strip

TEXT_EXTENSIONS = ("md", "markdown", "mdown", "txt")
MANUSCRIPT_EXTENSIONS = TEXT_EXTENSIONS[:3]


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))


def is_text_file(path: Column) -> Column:
    return extension(path).isin(*TEXT_EXTENSIONS)


def fits_role(path: Column, role: Column) -> Column:
    return (
        F.when(role == "primary_manuscript", extension(path).isin(*MANUSCRIPT_EXTENSIONS)).when(role.isin("reference", "notes"), is_text_file(path)).otherwise(False)
    )


def inside_hidden(path: Column) -> Column:
    """Whether a directory on the way to the file starts with a dot."""
    return path.rlike(r"(^|/)\.[^/]+/")


def normalize_mappings(mappings: DataFrame) -> DataFrame:
    """Adds normalized and error_code to each mapping row (path, role, enabled)."""
    path = strip(F.col("path"))
    parts = F.filter(F.split(path, "/+"), lambda x: ~x.isin("", "."))
    error = F.when(path == "", "empty_directory_path").when(path.startswith("/") | F.array_contains(parts, ".."), "unsafe_directory_path")
    clean = F.when(F.size(parts) == 0, ".").otherwise(F.array_join(parts, "/"))
    return mappings.withColumn("error_code", error).withColumn("normalized", F.when(error.isNull(), clean))


def validate_mappings(mappings: DataFrame) -> DataFrame:
    """One row per project: the first error of its mappings in order (project, seq, path, role, enabled), or null."""
    rows = normalize_mappings(mappings)
    again = F.row_number().over(Window.partitionBy("project", "normalized").orderBy("seq")) > 1
    rows = rows.withColumn("error_code", F.when(F.col("error_code").isNotNull(), F.col("error_code")).when(again, "duplicate_directory_path"))
    found = rows.groupBy("project").agg(F.min_by("error_code", F.when(F.col("error_code").isNotNull(), F.col("seq"))).alias("first"), F.count_if(F.col("enabled") & (F.col("role") == "primary_manuscript")).alias("primaries"))
    return found.select("project", F.coalesce("first", F.when(F.col("primaries") != 1, "invalid_primary_manuscript_count")).alias("error_code"))


def persisted_mappings(drafts: DataFrame) -> DataFrame:
    return drafts.where("role IS NOT NULL").select("path", "role", "enabled")


def merge_mappings(candidates: DataFrame, saved: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Scanned directories (path, suggested_role, seq) with what was saved for them, then saved ones (path, role, enabled) that were not scanned.

    What was saved wins whole. position counts within a project: scanned ones in
    their order, the rest by path in the order of a reader's alphabet. ``by``
    names columns that keep projects apart.
    """
    c = candidates.select(*by, "path", "suggested_role", "seq")
    s = saved.select(*by, "path", F.col("role").alias("saved_role"), F.col("enabled").alias("saved_enabled"), F.lit(True).alias("known"))
    kept = c.join(s, [*by, "path"], "left").select(
        *by,
        "path",
        F.when(F.col("known"), F.col("saved_role")).otherwise(F.col("suggested_role")).alias("role"),
        F.when(F.col("known"), F.col("saved_enabled")).otherwise(~F.col("suggested_role").eqNullSafe(F.lit("ignore"))).alias("enabled"),
        F.col("seq").cast("long").alias("seq"),
    )
    extra = s.join(c, [*by, "path"], "left_anti").select(*by, "path", F.col("saved_role").alias("role"), F.col("saved_enabled").alias("enabled"), F.lit(None).cast("long").alias("seq"))
    order = Window.partitionBy(*by).orderBy(F.col("seq").asc_nulls_last(), F.collate("path", "UNICODE"), "path")
    return kept.unionByName(extra).select(*by, "path", "role", "enabled", F.col("seq").isNotNull().alias("scanned"), (F.row_number().over(order) - 1).alias("position"))


def mapped_paths(files: DataFrame, mappings: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """path, role and seen of each file below a mapped directory.

    role is that of its most specific enabled mapping, the last of equals; seen
    tells whether a mapping other than ignore reaches the file without passing
    through a hidden directory. A path has few ancestor directories, so each
    file asks for those by one equi join; mappings need not be small. ``by``
    names columns that keep projects apart.
    """
    m = mappings.where("enabled").select(*by, F.col("path").alias("dir"), "role", "seq")
    best = m.groupBy(*by, "dir").agg(F.max_by("role", "seq").alias("role"), F.bool_or(F.col("role") != "ignore").alias("opens"))
    names = F.split("path", "/")
    prefix = F.transform(
        F.sequence(F.lit(0), F.size(names)),
        lambda k: F.struct(k.alias("depth"), F.when(k == 0, ".").otherwise(F.array_join(F.slice(names, 1, k), "/")).alias("dir"), F.array_join(F.slice(names, k + 1, F.size(names)), "/").alias("rest")),
    )
    each = files.select(*by, "path", F.explode(prefix).alias("p")).select(*by, "path", "p.*")
    seen = F.col("opens") & (F.col("rest") != "") & ~inside_hidden(F.col("rest"))
    return each.join(best, [*by, "dir"]).groupBy(*by, "path").agg(F.max_by("role", "depth").alias("role"), F.bool_or(seen).alias("seen"))


def document_type(path: Column, role: Column) -> Column:
    kind = F.when(role == "primary_manuscript", "manuscript").when(role == "reference", "reference").when(role == "notes", "note")
    return F.when(fits_role(path, role), kind)


def classify_paths(files: DataFrame, mappings: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """path and document_type (or null) of each file by its mapping."""
    found = mapped_paths(files, mappings, by)
    return files.select(*by, "path").distinct().join(found, [*by, "path"], "left").select(*by, "path", document_type(F.col("path"), F.col("role")).alias("document_type"))


def discover(files: DataFrame, mappings: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Typed documents of a project, hidden directories left out (but for a mapped one itself)."""
    found = mapped_paths(files, mappings, by).where("seen")
    return found.select(*by, "path", document_type(F.col("path"), F.col("role")).alias("document_type")).where("document_type IS NOT NULL")


def import_candidates(files: DataFrame, directories: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The root, if it holds a text file itself, and each directory below it with a suggested role and the reasons.

    ``by`` names columns that keep projects apart; directories lists those without files as well.
    """
    p = F.col("path")
    rows = files.select(*by, "path").where(~inside_hidden(p)).select(*by, F.when(p.contains("/"), F.substring_index("path", "/", 1)).otherwise(".").alias("dir"), is_text_file(p).alias("own"))
    seen = rows.groupBy(*by, "dir").agg(F.bool_or("own").alias("own"))
    listed = directories.where(~p.startswith(".") & ~p.contains("/")).select(*by, p.alias("dir")).unionByName(seen.where("dir <> '.'").select(*by, "dir")).distinct()
    out = listed.join(seen, [*by, "dir"], "left").unionByName(seen.where("dir = '.' AND own"))
    role = F.when(F.col("dir") == "chapters", "primary_manuscript").when(F.col("dir") == "world_context", "reference").when(F.col("dir") == "notes", "notes")
    own = F.coalesce("own", F.lit(False))
    reasons = F.array_compact(F.array(F.when(role.isNotNull(), F.concat(F.lit("directory_named_"), F.col("dir"))), F.when(own, "contains_supported_text_files")))
    return out.select(*by, F.col("dir").alias("path"), own.alias("contains_supported_text_files"), role.alias("suggested_role"), reasons.alias("suggestion_reasons"))
