"""Chat formatting by quotation linking (operator 8), DataFrame functions only.

A line's quote level is the number of '>' marks before its text. A message's own
lines are those of level 0, without the line that announces a quote. Quoted
lines are passages: folded to lower case, with one space for each run of other
characters than letters and digits, and hashed. A passage belongs to the first
message of its conversation that wrote it as a line. A quoted line that nobody
wrote as one, because it was wrapped anew or quotes a part, belongs to the first
message whose own words hold it: its words alone where they are RUN or more;
else with those after or before it in its quote, RUN in all (or the whole quote,
if shorter); else alone, from three words up. A message answers the earlier
message that most of its level-1 passages come from (the latest of equals),
one that quotes nothing answers the turn before, if there is one. Links give
each message its thread's first turn and its depth, by doubling the links that
are not plain replies to the turn before.

Rows come back in reply order (conversation, thread, turn), range partitioned,
so a long conversation is spread; each keeps its own words only.

Defined cases: a null text is empty; a quote whose words nobody wrote before is
counted but links nothing; repeated (conversation, turn) rows share their
links, and are told apart by nothing; null conversation or turn ids link to
nothing; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelake.llm.common import lookup, shuffled, written

MARKS = r"^(?:[ \t]*>)+"
ANNOUNCES = r"(?i)(wrote|writes|said|says|schrieb|a écrit|escribió)\s*:\s*$"
KEY = ["conv_id", "turn"]
RUN = 8


def folded(c: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def read_lines(messages: DataFrame) -> DataFrame:
    """Messages with ``lines``: an array of (level, body, announces)."""
    raw = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    marks = lambda x: F.regexp_extract(x, MARKS, 0)
    line = lambda x: F.struct(
        F.length(F.regexp_replace(marks(x), "[^>]", "")).alias("level"), F.regexp_replace(x, MARKS + "[ \t]?", "").alias("body"), x.rlike(ANNOUNCES).alias("announces")
    )
    return messages.withColumn("lines", F.transform(raw, line))


def own_text(lines: Column) -> Column:
    """Level-0 lines, without those that announce the quote in the next line, without white space around."""
    after = lambda i: F.coalesce(F.get(lines, i + 1).level, F.lit(0)) > 0
    kept = F.filter(lines, lambda x, i: (x.level == 0) & ~(x.announces & after(i)))
    return F.regexp_replace(F.array_join(F.transform(kept, lambda x: x.body), "\n"), r"^\s+|\s+$", "")


def passages(messages: DataFrame) -> DataFrame:
    """conv_id, turn, level, passage (hash) of every line with words; level 0 is the message's own."""
    rows = messages.select(*KEY, F.explode("lines").alias("l")).select(*KEY, "l.level", folded(F.col("l.body")).alias("words")).where("words <> ''")
    return rows.select(*KEY, "level", F.xxhash64("words", F.length("words")).alias("passage"))


def spans(messages: DataFrame) -> DataFrame:
    """conv_id, turn, level, passage (hash) and nth of every quoted line, with each run of words (span) that may tell its origin.

    Successive lines of one level are one quote; the smallest nth counts.
    """
    some = messages.where(F.contains("text", F.lit(">"))).select(F.monotonically_increasing_id().alias("id"), *KEY, "lines")
    rows = written(some.select("id", *KEY, F.posexplode("lines").alias("i", "l")).select("id", *KEY, "i", "l.level", folded(F.col("l.body")).alias("words")), "quotes")
    own = Window.partitionBy("id").orderBy("i")
    rows = rows.withColumn("opens", (F.col("level") != F.lag("level", 1, -1).over(own)).cast("int")).withColumn("quote", F.sum("opens").over(own))
    rows = rows.where("level > 0 AND words <> ''").withColumn("words", F.split("words", " "))
    before = Window.partitionBy("id", "quote").orderBy("i")
    rows = rows.withColumn("start", F.sum(F.size("words")).over(before) - F.size("words"))
    whole = rows.groupBy("id", "quote").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("i", "words"))), lambda x: x.words)).alias("all"))
    n, total = F.size("words"), F.size("all")
    after = F.slice("all", F.greatest(F.lit(0), F.least("start", total - RUN)) + 1, F.lit(RUN))
    ahead = F.slice("all", F.greatest(F.lit(0), F.col("start") + n - RUN) + 1, F.lit(RUN))
    ways = F.when(n >= RUN, F.array("words")).otherwise(F.concat(F.array(after, ahead), F.when(n >= 3, F.array("words")).otherwise(F.expr("array()"))))
    text = F.array_join("words", " ")
    out = shuffled(rows, whole, ["id", "quote"]).select(*KEY, "level", F.xxhash64(text, F.length(text)).alias("passage"), F.posexplode(ways).alias("nth", "span"))
    return out.select(*KEY, "level", "passage", "nth", F.size("span").alias("n"), F.array_join("span", " ").alias("span"), F.array_join(F.slice("span", 1, RUN), " ").alias("head"))


def holders(messages: DataFrame, asked: DataFrame) -> DataFrame:
    """conv_id, span, origin: the first turn whose own words hold each span that is asked for.

    Own words are met at the spans' first RUN words; only there longer runs are made, one for each length asked.
    """
    widths = asked.groupBy("conv_id").agg(F.collect_set(F.least("n", F.lit(RUN))).alias("widths"))  # at most RUN numbers
    own = lookup(messages.select(*KEY, folded(own_text(F.col("lines"))).alias("words")).where("words <> ''"), widths, ["conv_id"]).where("widths IS NOT NULL")
    own = written(own.select(F.monotonically_increasing_id().alias("id"), *KEY, F.split("words", " ").alias("words"), "widths"), "own")
    places = F.expr("flatten(transform(filter(widths, w -> w <= size(words)), w -> transform(sequence(0, size(words) - w), p -> struct(w, p, array_join(slice(words, p + 1, w), ' ') AS head))))")
    places = own.select("id", *KEY, F.explode(places).alias("p")).select("id", *KEY, "p.*")
    short = places.groupBy("conv_id", F.col("head").alias("span")).agg(F.min("turn").alias("origin"))
    longer = asked.where(F.col("n") > RUN).groupBy("conv_id", "head").agg(F.collect_set("n").alias("lengths"))  # at most the lengths of a line
    met = lookup(places.where(F.col("w") == RUN).drop("w"), longer, ["conv_id", "head"]).select("id", "p", F.explode("lengths").alias("n"))
    run = shuffled(met, own.select("id", *KEY, "words"), ["id"]).where("p + n <= size(words)").select(*KEY, F.expr("array_join(slice(words, p + 1, n), ' ')").alias("span"))
    return short.unionByName(run.groupBy("conv_id", "span").agg(F.min("turn").alias("origin")))


def further_origins(messages: DataFrame, asked: DataFrame) -> DataFrame:
    """conv_id, turn, level, passage, held: the earlier turn whose words hold a quoted line."""
    spans_held = shuffled(holders(messages, asked), asked.select("conv_id", "span").distinct(), ["conv_id", "span"], "left_semi")
    found = lookup(asked.select(*KEY, "level", "passage", "nth", "span"), written(spans_held, "held"), ["conv_id", "span"]).where("origin < turn")
    return found.groupBy(*KEY, "level", "passage").agg(F.min(F.struct("nth", "origin")).alias("held")).select(*KEY, "level", "passage", F.col("held.origin").alias("held"))


def reply_links(messages: DataFrame) -> DataFrame:
    """One row per (conv_id, turn): parent turn or null, quoted passages, and those linked."""
    told = written(passages(messages), "passages")
    first = told.where("level = 0").groupBy("conv_id", "passage").agg(F.min("turn").alias("origin"))
    quoted = told.where("level > 0").groupBy(*KEY, "level", "passage").agg(F.count("*").alias("n"))
    found = lookup(quoted, first, ["conv_id", "passage"]).withColumn("origin", F.when(F.col("origin") < F.col("turn"), F.col("origin")))
    if not quoted.isEmpty():
        found = written(found, "found")
        lost = found.where("origin IS NULL").select(*KEY, "level", "passage")
        asked = written(shuffled(spans(messages), lost, [*KEY, "level", "passage"], "left_semi"), "spans")
        found = lookup(found, written(further_origins(messages, asked), "further"), [*KEY, "level", "passage"]).withColumn("origin", F.coalesce("origin", "held"))
    votes = found.groupBy(*KEY, "origin").agg(F.sum(F.when(F.col("level") == 1, F.col("n")).otherwise(0)).alias("votes"), F.sum("n").alias("n"))
    real = F.when(F.col("origin").isNotNull() & (F.col("votes") > 0), F.struct("votes", "origin"))
    best = votes.groupBy(*KEY).agg(F.max(real).alias("best"), F.sum("n").alias("n_quoted"), F.sum(F.when(F.col("origin").isNotNull(), F.col("n")).otherwise(0)).alias("n_linked"))
    turns = messages.select(*KEY).distinct()
    earlier = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("turn").alias("previous"))
    out = shuffled(shuffled(turns, earlier, KEY, "left"), best, KEY, "left")
    return out.select(*KEY, F.coalesce("best.origin", "previous").alias("parent_turn"), F.coalesce("n_quoted", F.lit(0)).alias("n_quoted"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"))


def runs(links: DataFrame, block: int = 256) -> DataFrame:
    """Add ``head``: the first turn of the run of replies to the turn before that a message is in, within its block of turns."""
    opens = ~F.coalesce(F.col("parent_turn") == F.col("turn") - 1, F.lit(False)) | (F.pmod("turn", F.lit(block)) == 0)
    own = Window.partitionBy("conv_id", F.floor(F.col("turn") / block)).orderBy("turn")
    return links.withColumn("head", F.max(F.when(opens, F.col("turn"))).over(own))


def threads(links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Add root_turn and depth. Runs of plain replies shrink to their heads; only heads follow pointers, doubling them, until each is at a root."""
    links = written(runs(links), "runs")
    onto = links.select("conv_id", F.col("turn").alias("parent_turn"), F.col("head").alias("to"))
    heads = lookup(links.where("head = turn").select(*KEY, "parent_turn"), onto, ["conv_id", "parent_turn"])
    root = F.col("parent_turn").isNull()
    heads = written(
        heads.select(*KEY, F.coalesce("to", "turn").alias("root_turn"), F.when(root, 0).otherwise(1 + F.col("parent_turn") - F.col("to")).cast("long").alias("depth"), root.alias("done")), "heads"
    )
    done, rest = heads.where("done"), heads.where("NOT done")
    for _ in range(max_rounds):
        if rest.isEmpty():
            break
        onward = done.unionByName(rest).select("conv_id", F.col("turn").alias("root_turn"), F.col("root_turn").alias("far"), F.col("depth").alias("more"), F.col("done").alias("there"))
        step = lookup(rest.drop("done"), onward, ["conv_id", "root_turn"])
        step = written(step.select(*KEY, F.col("far").alias("root_turn"), (F.col("depth") + F.col("more")).alias("depth"), F.col("there").alias("done")), "pointers")
        done, rest = done.unionByName(step.where("done")), step.where("NOT done")
    else:
        raise RuntimeError("reply links did not settle")
    found = done.select("conv_id", F.col("turn").alias("head"), "root_turn", F.col("depth").alias("above"))
    return shuffled(links, found, ["conv_id", "head"]).withColumn("depth", F.col("above") + F.col("turn") - F.col("head")).drop("head", "above")


def reply_ordered(conversations: DataFrame) -> DataFrame:
    """Every message without its quotes, with its parent, thread and depth, in reply order."""
    messages = read_lines(conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text"))
    linked = threads(reply_links(messages))
    out = lookup(messages.select(*KEY, "role", own_text(F.col("lines")).alias("own_text")), linked, KEY)
    out = out.select(
        "conv_id", F.coalesce("root_turn", "turn").alias("root_turn"), "turn", "role", "parent_turn", F.coalesce("depth", F.lit(0).cast("long")).alias("depth"), F.coalesce("n_quoted", F.lit(0).cast("long")).alias("n_quoted"), F.coalesce("n_linked", F.lit(0).cast("long")).alias("n_linked"), "own_text"
    )
    return out.orderBy("conv_id", "root_turn", "turn")


ORACLE = r"""
WITH RECURSIVE raw AS (SELECT conv_id, turn, i, ls[i] AS line FROM (SELECT conv_id, turn, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT conv_id, turn, string_split(coalesce(text, ''), chr(10)) AS ls FROM conversations))),
l AS (SELECT conv_id, turn, i, length(regexp_replace(regexp_extract(line, '^(?:[ \t]*>)+'), '[^>]', '', 'g')) AS level, regexp_replace(line, '^(?:[ \t]*>)+[ \t]?', '') AS body, regexp_matches(line, '(?i)(wrote|writes|said|says|schrieb|a écrit|escribió)\s*:\s*$') AS ann FROM raw),
nx AS (SELECT *, coalesce(lead(level) OVER (PARTITION BY conv_id, turn ORDER BY i), 0) AS after FROM l),
own AS (SELECT conv_id, turn, regexp_replace(coalesce(string_agg(body, chr(10) ORDER BY i) FILTER (level = 0 AND NOT (ann AND after > 0)), ''), '^\s+|\s+$', '', 'g') AS own_text FROM nx GROUP BY conv_id, turn),
p AS (SELECT conv_id, turn, level, trim(regexp_replace(lower(body), '[^\p{L}\p{N}]+', ' ', 'g')) AS words FROM l),
f AS (SELECT conv_id, words, min(turn) AS origin FROM p WHERE level = 0 AND words <> '' GROUP BY conv_id, words),
q AS (SELECT p.conv_id, p.turn, p.level, CASE WHEN origin < p.turn THEN origin END AS origin FROM p LEFT JOIN f USING (conv_id, words) WHERE level > 0 AND words <> ''),
v AS (SELECT conv_id, turn, origin, count(*) FILTER (level = 1) AS votes FROM q WHERE origin IS NOT NULL GROUP BY conv_id, turn, origin),
best AS (SELECT conv_id, turn, arg_max(origin, votes * 1000000 + origin) AS origin FROM v WHERE votes > 0 GROUP BY conv_id, turn),
n AS (SELECT conv_id, turn, count(*) AS n_quoted, count(origin) AS n_linked FROM q GROUP BY conv_id, turn),
par AS (SELECT c.conv_id, c.turn, coalesce(b.origin, e.turn) AS parent_turn FROM (SELECT DISTINCT conv_id, turn FROM conversations) c LEFT JOIN best b USING (conv_id, turn) LEFT JOIN (SELECT DISTINCT conv_id, turn FROM conversations) e ON e.conv_id = c.conv_id AND e.turn = c.turn - 1),
walk AS (SELECT conv_id, turn, turn AS root_turn, 0 AS depth FROM par WHERE parent_turn IS NULL UNION ALL SELECT par.conv_id, par.turn, w.root_turn, w.depth + 1 FROM par JOIN walk w ON w.conv_id = par.conv_id AND w.turn = par.parent_turn)
SELECT c.conv_id, root_turn, c.turn, role, parent_turn, CAST(depth AS BIGINT) AS depth, CAST(coalesce(n_quoted, 0) AS BIGINT) AS n_quoted, CAST(coalesce(n_linked, 0) AS BIGINT) AS n_linked, own_text
FROM conversations c JOIN own USING (conv_id, turn) JOIN par USING (conv_id, turn) JOIN walk USING (conv_id, turn) LEFT JOIN n USING (conv_id, turn)
"""
