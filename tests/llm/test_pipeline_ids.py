import zlib

import numpy as np

import corpus_pipeline
from quillspark.llm import packing


def test_pipeline_packs_with_ids(spark):
    docs = spark.createDataFrame([(i, "some words of a text " * (i * 40)) for i in range(12)], "doc_id long, text string")
    out = corpus_pipeline.pack(spark, docs, "")
    pieces = out.collect()
    assert pieces and all(zlib.crc32(np.frombuffer(p.ids, "<u2").astype("<u4").tobytes()) == p.ids_crc32 and len(p.ids) == 2 * p.length for p in pieces)
    assert packing.sequences(out).count() == len({p.sequence_id for p in pieces})
