"""The registered queries on the smallest tables: contract columns, one row for each input row, DuckDB where there is SQL."""

import duckdb
import pytest

from vellum.llm import queries

FOLDER = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op2_ngram_join": "doc_id n_shingles component_id",
    "op3_sentencepiece": "doc_id n_tokens ids_crc32 decoded_sha256 parity",
    "op4_toxicity": "doc_id held_out score predicted",
    "op5_webp": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
    "op6_token_counts": "doc_id n_bytes n_tokens over_limit",
    "op7_suffix_dedup": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op8_language_id": "doc_id held_out lang_pred score",
    "op9_vector_dedup": "vec_id n_links component_id kept",
    "op10_chat_format": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
    "op11_prefix_trie": "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256",
    "op12_repetition": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op13_divergence": "lang source part item value rank",
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_contract(spark, name):
    df = queries.queries()[name](spark, FOLDER)
    assert set(COLUMNS[name].split()) <= set(df.columns)
    got = df.toPandas()
    if name == "op10_chat_format":
        assert len(got) == spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id").distinct().count() + 1 and -7 in set(got.conv_id)
    elif name not in ("op1_packing", "op11_prefix_trie", "op13_divergence"):
        source = "embeddings" if name == "op9_vector_dedup" else "documents"
        assert len(got) == spark.read.parquet(f"{FOLDER}/{source}.parquet").count()
    if name == "op3_sentencepiece":
        assert got.parity.all()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    cur = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    want = sorted(tuple(dict(zip(names, r, strict=True))[c] for c in sorted(names)) for r in cur.fetchall())
    df = queries.queries()[name](spark, FOLDER)
    assert sorted(tuple(r[c] for c in sorted(df.columns)) for r in df.collect()) == want


def test_every_operator_has_a_query():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.queries()) == list(range(1, 14))
