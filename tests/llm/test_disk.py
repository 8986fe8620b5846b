"""What stands on disk while an operator works."""

from __future__ import annotations

import time

import numpy as np
from pyspark.sql import functions as F

from vocalis.llm import shards, suffixes
from vocalis.llm.frames import saved, stored


def shuffled(spark) -> set[str]:
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return {b for k in range(blocks.size()) if (b := blocks.apply(k).toString()).startswith("shuffle_")}


def gone(spark, before: set[str]) -> bool:
    """Whether no shuffle file is left but those of before; Spark deletes them in a thread of its own."""
    for _ in range(50):
        if not shuffled(spark) - before:
            return True
        time.sleep(0.1)
    return False


def test_a_saved_frame_leaves_no_shuffle_files(spark):
    before = shuffled(spark)
    work = spark.range(1_000).groupBy((F.col("id") % 100).alias("k")).count()
    out, table = saved(work), stored(work)
    assert gone(spark, before)
    assert out.count() == table.count() == work.count() == 100


def test_pieces_are_gone_before_texts_travel(spark):
    rows = [(k, f"{k} " + "the same fifty bytes and some more of them stand in each of these documents") for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = suffixes.repeated_bytes(docs)
    assert "bucket" not in out._jdf.queryExecution().analyzed().toString()
    assert {r.doc_id for r in out.where("n_removed > 0").collect()} == set(range(1, 20))


def test_small_blobs_pack_as_well_as_large_ones():
    r = np.random.default_rng(1)
    text = bytes(r.choice(np.frombuffer(b"aaaeeeinnorstt  ", dtype=np.uint8), 20_000))
    columns = [np.sort(r.integers(0, 1 << 40, 300)), r.integers(0, 2_000, 300)]
    blob = shards.pack(columns, text)
    assert len(blob) <= len(shards.pack(columns)) + len(shards.pack([], text))
    back, payload = shards.unpack(blob)
    assert payload == text and all((a == b).all() for a, b in zip(back, columns, strict=True))
    assert shards.unpack(shards.pack(columns))[1] == b""


def test_blobs_of_earlier_versions_are_read():
    import zstandard

    columns = [np.arange(5)]
    raw = zstandard.ZstdDecompressor().decompress(shards.pack(columns))
    back, payload = shards.unpack(zstandard.ZstdCompressor().compress(raw + b"text"))
    assert payload == b"text" and back[0].tolist() == [0, 1, 2, 3, 4]
