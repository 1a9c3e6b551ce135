"""Line dedup by a segment-partition edit join (operator 2), DataFrame functions only.

Equal lines are one entry. How many edits two lines may differ in follows the
shorter one's length: ``STEPS`` gives one edit from 10 characters on, two from
30, none below. Two entries within ``tau`` edits share, somewhere, one of the
tau + 1 even segments of the shorter one unchanged: every entry puts its
segments into an index by length and segment number, and probes the index, for
each length that may match, with the few substrings that can stand at a
segment's place (positions limited by the edits that the left and the right
side may still hold).

Entries of a segment that more than ``crowd`` entries share are keyed anew by
nearly all of the line: of ``PARTS`` even parts at most tau are touched, so two
entries within reach agree on everything but one pair of parts, one or two
stretches that hold the edits. A crowded key of one stretch is refined again
within it, half by half, until it is no longer than the edits it may hold; the
ways to do so do not overlap, so an entry has no more keys at a level than
places where others differ from it. At a crowded key of two stretches with an
edit each, the distinct stretches of either side meet first, and entries only
through those that are an edit apart on both sides (``both_differ``).
Entries that share a key of this kind are a pair only if their
stretches are within the edits that they may hold, so candidates stay close to
the true links however large a group of variants is, and an entry is compared
with no more others at a key than a crowd has.
Only keys and ids are shuffled; texts move for candidates alone.

Candidates lose their common prefix and suffix (binary search over prefixes)
and are verified by a banded bit-parallel edit distance: one machine word holds
the vertical differences of the 2 tau + 1 diagonals in the band.

Linked entries form classes; the first line of a class (by doc_id, then line
number) stays. Blank lines are not compared and not returned.

Defined cases: a null text has no lines; a null doc_id is smallest; repeated
rows are copies, of which one row's line stays; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.llm.common import components, drop, lookup, small, written

#: Least length of a line, and the edits that are allowed from there on.
STEPS = ((10, 1), (30, 2))
#: Entries that may share a key before it is refined; where two stretches hold an edit each, a pair must differ in both.
CROWD, CROWD_APART = 8, 64
#: Parts of a stretch that holds two edits, and of one that holds one.
PARTS = {2: 4, 1: 4}


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, line of every line that is not blank."""
    split = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return split.where(F.length(F.btrim("line", F.lit(" \t\r"))) > 0)


def segment(length: str, k: str, parts: int) -> tuple[str, str]:
    """SQL: first place (from 1) and size of segment k of ``parts`` even ones; the last take what does not divide."""
    longer = f"({length} % {parts})"
    place = f"(({length} div {parts}) * {k} + greatest(0, {k} - {parts} + {longer}) + 1)"
    return place, f"(({length} div {parts}) + IF({k} >= {parts} - {longer}, 1, 0))"


#: SQL: a string with four bytes to each character, so that any place in it is reached at once.
WIDE = "encode({}, 'UTF-32')"


def wide_part(text: str, place: str, width: str) -> str:
    return f"substring({text}, 4 * ({place}) - 3, 4 * ({width}))"


def tried(entries: DataFrame, ways: list[tuple[int, int, int]], parts: int) -> DataFrame:
    """Entries times ``ways`` (shorter, k, move), each with the length of the index's entry and the substring that it stands for."""
    each = ", ".join(f"struct({', '.join(map(str, w))})" for w in ways)
    rows = entries.selectExpr("id", f"{WIDE.format('line')} AS line", "length(line) AS n")
    rows = rows.withColumn("w", F.explode(F.expr(f"cast(array({each}) as array<struct<shorter: int, k: int, move: int>>)")))
    place, size = segment("length", "k", parts)
    rows = rows.select("id", "line", "n", "w.*").withColumn("length", F.expr("n - shorter"))
    rows = rows.withColumn("place", F.expr(f"cast({place} + move as int)")).withColumn("width", F.expr(f"cast({size} as int)"))
    rows = rows.where("length >= 0 AND place >= 1 AND place + width - 1 <= n")
    return rows.withColumn("part", F.expr(wide_part("line", "place", "width")))


def bands() -> list[tuple[int, int, int]]:
    """(edits, least length, most length) of the shorter line."""
    tops = [least - 1 for least, _ in STEPS[1:]] + [(1 << 31) - 1]
    return [(tau, least, top) for (least, tau), top in zip(STEPS, tops, strict=True)]


def allowed(length: Column) -> Column:
    """The edits that a pair may differ in, by the length of its shorter line."""
    out = F.lit(0)
    for least, tau in STEPS:
        out = F.when(length >= least, tau).otherwise(out)
    return out


def index_rows(entries: DataFrame) -> DataFrame:
    """key, id, length: a segment's key, its entry, and the entry's length."""
    out = None
    for tau, least, top in bands():
        own = entries.where(F.length("line").between(least, top)).select("id", "line")
        rows = tried(own, [(0, k, 0) for k in range(tau + 1)], tau + 1)
        rows = rows.selectExpr(f"xxhash64({tau}, length, k, part) AS key", "id", "length")
        out = rows if out is None else out.unionByName(rows)
    return out


def probe_rows(entries: DataFrame) -> DataFrame:
    """key, id2: the substrings of an entry that may equal a segment of an entry not longer.

    id2 is twice the entry, and one more if it looks for entries of its own length.

    The left side holds at most k edits, seen from the left, the right side
    tau - k, seen from the right; that limits how far a segment may move.
    """
    out = None
    for tau, least, top in bands():
        ways = [
            (shorter, k, move)
            for shorter in range(tau + 1)
            for k in range(tau + 1)
            for move in range(max(-k, shorter - (tau - k)), min(k, shorter + (tau - k)) + 1)
        ]
        own = entries.where(F.length("line").between(least, top + tau if top < 1 << 30 else top)).select("id", "line")
        rows = tried(own, ways, tau + 1).where(F.col("length").between(least, top))
        rows = rows.selectExpr(f"xxhash64({tau}, length, k, part) AS key", "id * 2 + int(shorter = 0) AS id2")
        out = rows if out is None else out.unionByName(rows)
    return out


def whole(entries: DataFrame, moves: bool) -> DataFrame:
    """The stretch that a line is to begin with: x, the length xn that it has in the index, and its edits xe; no second one.

    Probes (``moves``) look for shorter lines, and for lines of their own length
    only if they are not in the index themselves (``indexed``): such lines meet there.
    """
    out = None
    for tau, least, top in bands():
        every, shorter = (F.array(*map(F.lit, range(first, tau + 1))) for first in (0, 1))
        ways = F.when(F.col("indexed"), shorter).otherwise(every) if moves else F.array(F.lit(0))
        own = entries.select("id", "line", F.explode(ways).alias("shorter"))
        rows = own.selectExpr(f"xxhash64({tau}, length(line) - shorter) AS key", "id", "id * 2 + int(shorter = 0) AS id2", "line AS x", "length(line) - shorter AS xn", f"{tau} AS xe", "'' AS y", "0 AS yn", "0 AS ye")
        rows = rows.where(F.col("xn").between(least, top))
        out = rows if out is None else out.unionByName(rows)
    return out


def ways_of(rows: DataFrame, ways: list[tuple[int, ...]], fits: str | None = None) -> DataFrame:
    """Rows times ways w (p, q, move); those that do not fit a row are not made."""
    each = ", ".join(f"struct({', '.join(map(str, w))})" for w in ways)
    each = f"cast(array({each}) as array<struct<p: int, q: int, move: int>>)"
    return rows.withColumn("w", F.explode(F.expr(f"filter({each}, w -> {fits})" if fits else each))).select(*rows.columns, "w.*")


def sides(rows: DataFrame, ways: list[tuple[int, ...]], fits: str | None = None) -> DataFrame:
    """Rows of two edits times ways (p, q, move), with places and sizes of the two parts."""
    (sp, zp), (sq, zq) = segment("xn", "p", PARTS[2]), segment("xn", "q", PARTS[2])
    return ways_of(rows.where("xe = 2"), ways, fits).selectExpr("*", f"cast({sp} as int) AS sp", f"cast({zp} as int) AS zp", f"cast({sq} as int) AS sq", f"cast({zq} as int) AS zq", "length(x) - xn AS more")


def apart(rows: DataFrame, moves: tuple[int, ...]) -> DataFrame:
    """Stretches of two edits cut to a part of each half, with one edit each, and the text between them moved."""
    half = PARTS[2] // 2
    ways = [(p, q, s) for p in range(half) for q in range(half, PARTS[2]) for s in moves]
    return sides(rows, ways, "abs(length(x) - xn - w.move) <= 1").where("zp + move >= 0 AND zq + more - move >= 0").selectExpr(
        "xxhash64(key, p, q, left(x, sp - 1), substring(x, sp + zp + move, sq - sp - zp), right(x, xn - sq - zq + 1)) AS key",
        "id", "id2", "substring(x, sp, zp + move) AS x", "zp AS xn", "1 AS xe", "substring(x, sq + move, zq + more - move) AS y", "zq AS yn", "1 AS ye",
    )


def narrowed(rows: DataFrame, moves: tuple[int, ...] = (0,)) -> DataFrame:
    """Rows (key, id, id2, x, xn, xe, y, yn, ye) with shorter stretches, and keys that also hold all that is left out of them.

    A stretch with two edits gives each half with both, or a part of each half
    with one each, where probes try how far the text between has moved
    (``moves``); a stretch with one edit gives the part that holds it. Nothing
    overlaps: two entries whose edits lie at one place share one key a level,
    not one for each way to get there.
    """
    near = sides(rows, [(p, p + 1, 0) for p in range(0, PARTS[2], 2)]).where("zp + zq + more >= 0").selectExpr(
        "xxhash64(key, p, q, left(x, sp - 1), right(x, xn - sq - zq + 1)) AS key", "id", "id2", "substring(x, sp, zp + zq + more) AS x", "zp + zq AS xn", "2 AS xe", "'' AS y", "0 AS yn", "0 AS ye"
    )
    far = apart(rows, moves)
    few = PARTS[1]
    (sp, zp), (sq, zq) = segment("xn", "p", few), segment("yn", "q", few)
    one = ways_of(rows.where("xe = 1"), [(p, q, 0) for p in range(few) for q in range(few)], "ye = 1 OR w.q = 0")
    one = one.selectExpr("*", f"cast({sp} as int) AS sp", f"cast({zp} as int) AS zp", f"cast({sq} as int) AS sq", f"IF(ye = 0, 0, cast({zq} as int)) AS zq", "length(x) - xn AS more", "length(y) - yn AS also")
    one = one.where("zp + more >= 0 AND zq + also >= 0").selectExpr(
        "xxhash64(key, p, q, left(x, sp - 1), right(x, xn - sp - zp + 1), IF(ye = 0, '', left(y, sq - 1)), IF(ye = 0, '', right(y, yn - sq - zq + 1))) AS key",
        "id", "id2", "substring(x, sp, zp + more) AS x", "zp AS xn", "xe", "IF(ye = 0, '', substring(y, sq, zq + also)) AS y", "zq AS yn", "ye",
    )
    return near.unionByName(far).unionByName(one)


def stretches(rows: DataFrame, name: str) -> DataFrame:
    """Rows (key, id and so on) with their stretches named, and the edits that these may hold."""
    return rows.selectExpr(*(c for c in rows.columns if c not in ("x", "xn", "xe", "y", "yn", "ye")), *(f"{c} AS {c}_{name}" for c in ("x", "y", "xe", "ye")))


#: SQL: the stretches of a pair that shares a key differ as far as they may. With an edit in each of two, both differ: pairs
#: that differ in one of them have keys with one stretch as well. A pair within reach has a key whose stretches hold its edits.
WITHIN = """(ye_a = 0 OR (x_a <> x_b AND y_a <> y_b))
    AND levenshtein(x_a, x_b, 2) BETWEEN 0 AND xe_a AND (ye_a = 0 OR levenshtein(y_a, y_b, 2) BETWEEN 0 AND ye_a)"""


def candidates(entries: DataFrame, crowd: int = CROWD, crowd_apart: int = CROWD_APART) -> DataFrame:
    """Pairs a < b of entries that share a key, each once; a written table."""
    index, probe = written(index_rows(entries), "index"), probe_rows(entries)
    crowded = index.groupBy("key").agg(F.count("*").alias("n"), F.min("length").alias("length")).where(F.col("n") > crowd)
    crowded = written(crowded.select("key", "length"), "crowded")
    few = small(crowded).select("key")
    a, b = left_over(index, few).select(F.col("key").alias("own"), F.col("id").alias("a")), probe.select("key", "id2")
    found = [written(a.join(b, F.expr(f"own = key AND {ONCE}")).selectExpr(*PAIR).distinct(), "pairs")]
    if crowded.isEmpty():
        drop(index, crowded)
        return found[0]
    # Only lines about as long as those behind a crowded key can have one.
    most = max(tau for _, tau in STEPS)
    sizes = crowded.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(most)), lambda k: F.col("length") + k)).alias("n")).distinct()
    sizes = written(sizes, "sizes")
    alike = written(entries.select("id", "line").join(small(sizes), F.length("line") == F.col("n"), "left_semi"), "alike", compression="zstd")
    ids = (index.join(few, "key", "left_semi").select("id"), probe_rows(alike).join(few, "key", "left_semi").selectExpr("shiftright(id2, 1) AS id"))
    own = [written(i.distinct(), "crowd") for i in ids]
    both = small(own[0].withColumn("indexed", F.lit(True)))
    more = [alike.join(small(own[0]), "id", "left_semi"), alike.join(small(own[1]), "id", "left_semi").join(both, "id", "left").withColumn("indexed", F.col("indexed").isNotNull())]
    more = [written(m, "crowd") for m in more]
    drop(*own, sizes, alike, index, crowded)
    found += refined(*(whole(t, moves) for t, moves in zip(more, (False, True), strict=True)), crowd, crowd_apart)
    drop(*more)
    every = written(union(found).distinct(), "pairs")
    drop(*found)
    return every


def union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


#: SQL: two entries of one length find each other both ways: the larger one's find counts; and the pair.
ONCE = "a <> shiftright(id2, 1) AND (id2 % 2 = 0 OR a < shiftright(id2, 1))"
PAIR = ("least(a, shiftright(id2, 1)) AS a", "greatest(a, shiftright(id2, 1)) AS b")


def left_over(index: DataFrame, few: DataFrame) -> DataFrame:
    """What is left of the index has no crowded key, so its hash table in a task follows the task's rows."""
    return index.join(few, "key", "left_anti").hint("shuffle_hash")


def refined(index: DataFrame, probe: DataFrame, crowd: int, crowd_apart: int) -> list[DataFrame]:
    """Written tables of pairs a < b of entries that share a key and are within its edits; crowded keys are narrowed until none is left."""
    found: list[DataFrame] = []
    aside: list[list[DataFrame]] = []
    old: list[DataFrame] = []
    while True:
        # Lines of one length probe each other only where the text between two edits has moved. Both tables are read more than
        # once and are written, so that each row is made once.
        index, probe = written(narrowed(index), "index"), written(narrowed(probe, (-1, 0, 1)).unionByName(apart(index, (-1, 1))), "probe", compression="zstd")
        crowded = index.where("xn > xe OR yn > ye").groupBy("key").agg(F.count("*").alias("n"), F.max("ye").alias("ye"))
        crowded = written(crowded.where(F.col("n") > F.when(F.col("ye") == 1, crowd_apart).otherwise(crowd)).select("key", "ye"), "crowded")
        few = small(crowded).select("key")
        kept = left_over(index, few)
        a = stretches(kept.select("key", F.col("id").alias("a"), "x", "y", "xe", "ye"), "a").withColumnRenamed("key", "own")
        b = stretches(probe.select("key", "id2", "x", "y", "xe", "ye"), "b")
        pairs = a.join(b, F.expr(f"own = key AND {ONCE} AND {WITHIN}")).selectExpr(*PAIR)
        # Lines of one length, the text between their edits not moved.
        c = stretches(kept.select("key", F.col("id").alias("b"), "x", "y", "xe", "ye"), "b")
        pairs = pairs.unionByName(a.join(c, F.expr(f"own = key AND a < b AND {WITHIN}")).select("a", "b"))
        found.append(written(pairs.distinct(), f"pairs{len(found)}"))
        more = [written(r.join(few, "key", "left_semi"), "crowd") for r in (index, probe)]
        kinds = {r.ye for r in crowded.select("ye").distinct().collect()}
        drop(index, probe, crowded)
        if 1 in kinds:
            aside.append([m.where("ye = 1") for m in more])
        old += more
        if 0 not in kinds:
            break
        index, probe = (m.where("ye = 0") for m in more)
    if aside:
        found.append(both_differ(*map(union, zip(*aside, strict=True)), crowd, crowd_apart))
    drop(*old)
    return found


def both_differ(index: DataFrame, probe: DataFrame, crowd: int, crowd_apart: int) -> DataFrame:
    """Pairs a < b of entries that share a key and whose two stretches differ by an edit each; a written table.

    A crowd holds few stretches on one side for each that differs on the other.
    So not entries meet but the distinct stretches of a side, by the place of
    their one edit, and entries meet through pairs of these on both sides.
    """
    rows = index.selectExpr("key", "id * 2 + 1 AS id2", "x", "y", "true AS indexed").unionByName(probe.selectExpr("key", "id2", "x", "y", "false AS indexed"))
    values = union([rows.selectExpr("key", f"{side} AS side", f"{c} AS s") for side, c in enumerate("xy")]).distinct()
    values = written(values.select(F.monotonically_increasing_id().alias("id"), "key", "side", "s"), "values", compression="zstd")
    own, shorter = (
        values.selectExpr(f"xxhash64(key, side, length(s) - {less}) AS key", "id", "id * 2 AS id2", "s AS x", f"length(s) - {less} AS xn", "1 AS xe", "'' AS y", "0 AS yn", "0 AS ye").where("xn >= 0")
        for less in (0, 1)
    )
    met = refined(own, shorter, crowd, crowd_apart)
    near = written(union(met).select(F.explode(F.expr("array(struct(a AS v, b AS w), struct(b AS v, a AS w))")).alias("p")).select("p.*").distinct(), "near")
    some = near.select("v").distinct()
    for side, c in enumerate("xy"):
        value = values.where(f"side = {side}").join(small(some), F.col("id") == F.col("v"), "left_semi").select("key", F.col("s").alias(c), F.col("id").alias(f"{c}v"))
        rows = rows.join(value, ["key", c])
    rows = written(rows.select("id2", "xv", "yv", "indexed"), "rows")
    a = rows.where("indexed").selectExpr("shiftright(id2, 1) AS a", "xv AS xa", "yv AS ya")
    pairs = a.join(near.selectExpr("v AS xa", "w AS xv"), "xa").join(rows.select("id2", "xv", "yv"), "xv").where(ONCE)
    pairs = pairs.join(near.selectExpr("v AS ya", "w AS yv"), ["ya", "yv"], "left_semi")
    pairs = written(pairs.selectExpr(*PAIR).distinct(), "pairs")
    drop(*met, values, near, rows)
    return pairs


def banded_distance(a: str, b: str, tau: int) -> str:
    """SQL: edit distance of two arrays of characters within a band of 2 tau + 1 diagonals, one bit each.

    The arrays start with tau + 1 equal fillers. ``cost`` follows the lowest
    diagonal as long as it is inside the first array, then that array's last row.
    """
    width, full = 2 * tau + 1, (1 << (2 * tau + 1)) - 1
    match = " + ".join(f"IF(get({a}, j - {tau} + {k} - 1) = get({b}, j - 1), {1 << k}, 0)" for k in range(width))
    d0 = f"((((m & s.vp) + s.vp) ^ s.vp) | m | s.vn) & {full}"
    hp = f"((s.vn | ~(({d0}) | s.vp)) & {full})"
    hn = f"(({d0}) & s.vp)"
    x = f"shiftright({d0}, 1)"
    row = f"shiftleft(1, size({a}) - s.j - 1 + {tau})"
    cost = f"""s.cost + IF(s.j + 1 <= size({a}) - {tau}, IF((({d0}) & {1 << (width - 1)}) = 0, 1, 0),
        IF(({hp} & {row}) <> 0, 1, 0) - IF(({hn} & {row}) <> 0, 1, 0))"""
    return f"""aggregate(transform(sequence(1, size({b})), j -> {match}),
        named_struct('j', 0, 'vp', {((1 << (tau + 1)) - 1) << tau}, 'vn', 0, 'cost', {tau}),
        (s, m) -> named_struct('j', s.j + 1, 'vp', ({hn} | ~({x} | {hp})) & {full}, 'vn', {x} & {hp}, 'cost', {cost}),
        s -> s.cost)"""


def stage(pairs: DataFrame, **made: str) -> DataFrame:
    """Add columns through a generator: no later filter or use may copy their expressions."""
    rest = [c for c in pairs.columns if c not in made]
    fields = ", ".join(f"{e} AS {c}" for c, e in made.items())
    return pairs.select(*rest, F.explode(F.expr(f"array(struct({fields}))")).alias("made")).select(*rest, "made.*")


#: Binary digits of the longest common prefix that is found whole.
DIGITS = 20


def common(behind: str | None = None) -> str:
    """SQL: the number of leading characters that wide strings x, y share, or of last ones, not counting the ``behind`` first; digit by digit from the highest."""
    rest = f"least(nx, ny) - {behind}" if behind else "least(nx, ny)"
    x, y = (wide_part(c, f"n{c} - n - s + 1" if behind else "n + 1", "s") for c in "xy")
    return f"aggregate(array({', '.join(str(1 << k) for k in reversed(range(DIGITS)))}), 0, (n, s) -> IF(n + s <= {rest} AND {x} = {y}, n + s, n))"


def with_distance(pairs: DataFrame, tau: int) -> DataFrame:
    """Add ``distance`` to pairs of strings x, y whose lengths differ by tau at most; pairs that are farther apart may go."""
    pairs = stage(pairs, nx="length(x)", ny="length(y)", x=WIDE.format("x"), y=WIDE.format("y"))
    pairs = stage(stage(pairs, head=common()), tail=common(behind="head"))
    # What is left begins and ends with an edit; with two at most, all between stands as it is, moved by one at most.
    if tau <= 2:
        middle = "nx - head - tail - 4"
        moved = " OR ".join(f"{wide_part('x', 'head + 3', middle)} = {wide_part('y', f'head + {3 + move}', middle)}" for move in (0, -1, 1))
        pairs = pairs.where(f"nx >= {1 << DIGITS} OR {middle} <= 0 OR {moved}")
    # The fillers also stand before a U+FEFF that would be taken for a byte order mark.
    filler = WIDE.format(f"repeat('-', {tau + 1})")
    rest = {c: f"split(decode(concat({filler}, {wide_part(c, 'head + 1', f'n{c} - head - tail')}), 'UTF-32'), '')" for c in ("x", "y")}
    return stage(pairs, **rest).transform(lambda p: stage(p, distance=banded_distance("x", "y", tau))).drop("x", "y", "nx", "ny", "head", "tail")


def edit_links(entries: DataFrame) -> DataFrame:
    """a, b, distance of entries (id, line) within the edits that their length allows; a written table."""
    most = max(tau for _, tau in STEPS)
    found = candidates(entries)
    asked = written(found.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "asked")
    text = written(entries.select("id", "line").join(small(asked), "id", "left_semi"), "texts", compression="zstd")
    pairs = found.join(text.select(F.col("id").alias("a"), F.col("line").alias("x")), "a")
    pairs = pairs.join(text.select(F.col("id").alias("b"), F.col("line").alias("y")), "b")
    pairs = pairs.withColumn("most", allowed(F.least(F.length("x"), F.length("y"))))
    pairs = pairs.where(F.abs(F.length("x") - F.length("y")) <= F.col("most"))
    links = written(with_distance(pairs, most).where(F.col("distance") <= F.col("most")).select("a", "b", "distance"), "links")
    drop(found, asked, text)
    return links


def line_dedup(docs: DataFrame) -> DataFrame:
    """Every line with its class (the class's first line), copies, links and whether it stays."""
    key = [F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2")]
    entries = lines(docs).groupBy("line").agg(F.count("*").alias("n_copies"))
    entries = written(entries.select(F.monotonically_increasing_id().alias("id"), "line", "n_copies"), "lines")
    links = edit_links(entries)
    degree = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("n_links"))
    linked = components(links.select("a", "b")).join(degree, "id")
    known = entries.select("id", "n_copies", *key).join(linked, "id", "left")
    known = known.where("n_copies > 1 OR n_links > 0").select("h1", "h2", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "id").alias("class"))
    known = written(known, "known")
    drop(entries, links)
    each = lines(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row_id")).select(F.struct("doc_id", "row_id").alias("doc_id"), "text"))
    each = each.select("doc_id", "line_no", *key)
    each = written(lookup(each, known, ["h1", "h2"]).select("doc_id", "line_no", "n_copies", "n_links", "class"), "each")
    drop(known)
    first = each.where("class IS NOT NULL").groupBy("class").agg(F.min(F.struct("doc_id", "line_no")).alias("first"))
    out = lookup(each, first, ["class"])
    alone = F.col("class").isNull()
    return out.select(
        F.col("doc_id.doc_id").alias("doc_id"),
        F.col("line_no").cast("long").alias("line_no"),
        F.when(alone, F.col("doc_id.doc_id")).otherwise(F.col("first.doc_id.doc_id")).alias("class_doc_id"),
        F.when(alone, F.col("line_no")).otherwise(F.col("first.line_no")).cast("long").alias("class_line_no"),
        F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        (alone | (F.struct("doc_id", "line_no") == F.col("first"))).alias("kept"),
    )


ORACLE = """
WITH RECURSIVE occ AS (
  SELECT doc_id, i - 1 AS line_no, ls[i] AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))
  WHERE trim(ls[i], ' ' || chr(9) || chr(13)) <> ''),
d AS (SELECT line, count(*) AS n_copies, min(doc_id * 1000000 + line_no) AS id, length(line) AS n FROM occ GROUP BY line),
link AS (SELECT a.id AS a, b.id AS b FROM (SELECT * FROM d WHERE n >= 10) a JOIN (SELECT * FROM d WHERE n >= 10) b
         ON b.n BETWEEN a.n - 2 AND a.n + 2 AND a.id <> b.id AND levenshtein(a.line, b.line) <= CASE WHEN least(a.n, b.n) >= 30 THEN 2 ELSE 1 END),
reach AS (SELECT a AS id, a AS other FROM link UNION SELECT r.id, l.b FROM reach r JOIN link l ON r.other = l.a),
cls AS (SELECT id, min(other) AS class FROM reach GROUP BY id),
deg AS (SELECT a AS id, count(*) AS n_links FROM link GROUP BY a)
SELECT occ.doc_id, CAST(occ.line_no AS BIGINT) AS line_no, CAST(coalesce(class, id) // 1000000 AS BIGINT) AS class_doc_id, CAST(coalesce(class, id) % 1000000 AS BIGINT) AS class_line_no,
       n_copies, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, occ.doc_id * 1000000 + occ.line_no = coalesce(class, id) AS kept
FROM occ JOIN d USING (line) LEFT JOIN cls USING (id) LEFT JOIN deg USING (id)
"""
