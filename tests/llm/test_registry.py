"""Registered queries against their SQL twins, and the columns that all of them promise."""

import pytest

from querent.llm import registry
from tests.compare import connect, differences

SF = "/root/testdata/sf0.01"
COLUMNS = {
    1: "doc_id n_words n_removed kept_sha256",
    2: "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
    3: "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    4: "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    5: "doc_id n_tokens ids_sha256 decoded_sha256",
    8: "doc_id held_out lang_pred score",
    9: "doc_id piece start length ids_crc32 sequence_id offset",
    10: "doc_id n_shingles component_id",
    11: "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256",
    12: "doc_id n_features weight score rank",
    13: "page_id payload_bytes payload_digest record_type refers_to",
}


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_sql_twin(spark, name):
    assert differences(spark, connect(SF), name, registry.QUERIES[name], registry.ORACLE_SQL[name], SF) is None


@pytest.mark.parametrize("n", sorted(COLUMNS))
def test_columns(spark, n):
    (name,) = [q for q in registry.QUERIES if q.startswith(f"op{n}_")]
    assert set(COLUMNS[n].split()) <= set(registry.QUERIES[name](spark, "/root/testdata/sf0.001").columns)
