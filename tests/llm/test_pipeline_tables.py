"""What the pipeline's near-duplicate stage leaves in the shared folder."""

import os

import corpus_pipeline
from llm_rows import SF

from tidemark.llm import common


def test_near_dedup_leaves_the_keys_of_its_documents_only(table, ready):
    shared = ready.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(shared))
    with common.intermediates(ready):
        kept = corpus_pipeline.near_dedup(ready, table[0], SF)
        (left,) = set(os.listdir(shared)) - before
        assert left.startswith("heads-") and kept.count() == ready.read.parquet(f"{shared}/{left}").count()
    assert set(os.listdir(shared)) == before
