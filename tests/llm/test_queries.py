import pytest

from emberlog.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
#: The columns of the contracts.
COLUMNS = {
    "op1_ngram_join": "doc_id n_shingles component_id", "op2_ann": "query_id rank vec_id score", "op3_warc": "page_id payload_bytes payload_digest record_type refers_to",
    "op4_secrets": "doc_id n_assign n_access n_hex base_sha256 spans", "op5_bpe": "doc_id n_tokens ids_sha256 decoded_sha256", "op6_langid": "doc_id held_out lang_pred score",
    "op7_toxicity": "doc_id held_out score predicted", "op8_decontamination": "doc_id item_id n_windows coverage", "op9_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op10_line_dedup": "doc_id n_lines n_dropped kept_sha256", "op11_exact_dedup": "doc_id keep_id group_size kept text_sha256",
    "op12_merkle": "doc_id leaf subroot root proof_sha256 folded_root verified", "op13_divergence": "lang source part item value rank",
}
KINDS = {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "query_id": "bigint", "vec_id": "bigint", "rank": "int", "score": "double", "page_id": "bigint", "payload_bytes": "bigint", "refers_to": "bigint", "n_tokens": "bigint", "held_out": "boolean", "predicted": "int", "size": "bigint", "text_crc32": "bigint", "shard": "int", "slot": "bigint", "grown_shard": "int", "n_lines": "bigint", "n_dropped": "bigint", "n_assign": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "verified": "boolean", "value": "bigint"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_columns_and_rows(spark, name):
    out = QUERIES[name](spark, SF)
    assert out.columns == COLUMNS[name].split() and all(KINDS.get(c, t) == t for c, t in out.dtypes)
    rows = out.collect()
    whole = {"op2_ann": 50, "op3_warc": 50}.get(name, 200)
    assert len(rows) == whole if name not in ("op8_decontamination", "op13_divergence") else rows


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    columns = COLUMNS[name].split()
    want = sorted(map(str, con.sql(SQL[name]).select(*columns).fetchall()))
    assert sorted(str(tuple(r)) for r in QUERIES[name](spark, SF).select(*columns).collect()) == want
