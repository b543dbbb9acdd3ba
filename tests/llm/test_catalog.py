"""The registered queries' columns and rows on the smallest table."""

import pytest

import __spark_entry__
from llm_rows import SF

from tidemark.llm import catalog

COLUMNS = {
    "op1_token_counts": "doc_id bigint, n_bytes bigint, n_pretokens bigint, n_tokens bigint",
    "op2_secret_scan": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op3_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op4_media_columns": "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string",
    "op5_token_files": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op6_substring_dedup": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op7_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op8_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op9_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op10_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op11_importance_resampling": "doc_id bigint, n_features bigint, weight bigint, score bigint, rank bigint",
    "op12_jaccard_join": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op13_vector_codes": "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string",
}


@pytest.mark.parametrize("name", COLUMNS)
def test_contract(ready, name):
    df = catalog.queries()[name](ready, SF)
    types = dict(df.dtypes)
    for column in COLUMNS[name].split(", "):
        column, kind = column.split()
        assert types[column] == kind
    rows = df.collect()
    if name == "op13_vector_codes":
        assert {r["vec_id"] for r in rows} == set(range(500)) and len({r["codebooks_sha256"] for r in rows}) == 1
        return
    ids = {r["doc_id"] for r in rows}
    assert ids == set(range(200)) and (len(rows) == 200) == (name != "op10_packing")
    if name == "op3_simhash":
        assert all(len(r["fingerprint"]) == 16 and r["component_id"] <= r["doc_id"] for r in rows)
    if name == "op5_token_files":
        at = 0
        for r in sorted(rows, key=lambda r: r["doc_id"]):
            assert r["start"] == at
            at += r["n_tokens"]


def test_all_are_registered():
    assert set(catalog.queries()) == set(COLUMNS) and set(__spark_entry__.queries()) > {*COLUMNS, "pipeline"} and set(catalog.oracle_sql()) < set(COLUMNS)
