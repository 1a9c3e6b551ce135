"""Crowds of variants of one line: what meets stays near what is linked."""

import itertools
import random

from pyspark.sql import functions as F

from quirelake.llm import line_dedup
from quirelake.llm.common import written
from tests.llm.test_contracts import close, words


def test_variants_with_other_words_do_not_all_meet(spark):
    rng = random.Random(8)
    base, made = words(rng, 24).split(), set()
    for k in range(48):
        own = list(base)
        own[rng.randrange(24)] = f"q{k:03}zz"
        made.add(" ".join(own))
    for _ in range(6):
        line = " ".join(base)
        at = rng.randrange(len(line))
        made.add(line[:at] + "#" + line[at + 1 :])
    lines = sorted(made)
    entries = written(spark.createDataFrame(list(enumerate(lines)), "id long, line string"), "lines")
    found = {(r.a, r.b) for r in line_dedup.candidates(entries).collect()}
    wanted = {(a, b) for (a, x), (b, y) in itertools.combinations(enumerate(lines), 2) if close(x, y)}
    assert wanted and wanted <= found
    assert len(found) < len(wanted) + 4 * len(lines)


def test_a_crowds_narrowed_rows_are_made_once(spark, monkeypatch):
    rng, made, wanted = random.Random(9), spark.sparkContext.accumulator(0), []
    base, narrowed = words(rng, 24), line_dedup.narrowed

    @F.udf("boolean")
    def told(_):
        made.add(1)
        return True

    def counted(rows, *moves):
        out = narrowed(rows, *moves)
        wanted.append(out.count())
        return out.where(told.asNondeterministic()("id"))

    monkeypatch.setattr(line_dedup, "narrowed", counted)
    lines = sorted({base[:at] + "#" + base[at + 1 :] for at in range(0, len(base), 3)})
    entries = written(spark.createDataFrame(list(enumerate(lines)), "id long, line string"), "lines")
    assert line_dedup.candidates(entries).count() == len(lines) * (len(lines) - 1) // 2
    assert wanted and made.value == sum(wanted)


def test_edits_at_one_place_share_one_key_a_level(spark):
    base = "".join(random.Random(3).choices("abcdefgh", k=256))
    at = 100
    lines = [base[:at] + x + base[at + 2 :] for x in ("qr", "st")]
    rows = line_dedup.whole(spark.createDataFrame(list(enumerate(lines)), "id long, line string"), False)
    for _ in range(5):
        rows = written(line_dedup.narrowed(rows), "rows")
        shared = rows.where("ye = 0").groupBy("key").count().where("count > 1")
        assert shared.count() == 1
        rows = rows.join(shared.select("key"), "key", "left_semi")
