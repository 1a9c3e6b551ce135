"""What a task of the context tree holds of a block of texts."""

import random
import tracemalloc

import numpy as np
import pyarrow.parquet as pq

from quirelake.llm import context_tree


def test_a_block_is_counted_slice_by_slice(spark, monkeypatch):
    """Python objects are made for a slice of the block, not for all its words and grams."""
    rng = random.Random(11)
    texts = [" ".join(f"{rng.getrandbits(40):x}" for _ in range(5_000)) for _ in range(100)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    made = context_tree.blocks(docs, 1 << 30)
    monkeypatch.setattr(context_tree, "mapped", lambda df, run, schema: (df, run))
    df, run = context_tree.count_blocks(made, 1, 7, 2, context_tree.Deal([4], np.zeros(0, np.int64)))
    batches = df.toArrow().to_batches()
    assert sum(b.num_rows for b in batches) == 1
    tracemalloc.start()
    assert sum(b.num_rows for b in run(iter(batches))) == 4
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 16 * sum(map(len, texts))


def test_large_rows_are_read_one_by_one(spark, monkeypatch):
    """A reader holds a whole row group, so a block has one of its own."""
    kept, write = [], context_tree.written
    monkeypatch.setattr(context_tree, "written", lambda df, what="table", **options: kept.append(write(df, what, **options)) or kept[-1])
    docs = spark.createDataFrame([(k, "some words " * 50) for k in range(60)], "doc_id long, text string").coalesce(1)
    assert context_tree.score_documents(docs, block_bytes=4_000).count() == 60
    found = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in kept[0].inputFiles()]
    assert sum(m.num_rows for m in found) > 5
    assert all(m.row_group(k).num_rows == 1 for m in found for k in range(m.num_row_groups))
