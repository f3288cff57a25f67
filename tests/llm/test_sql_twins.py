import pytest

from engram.llm import registry

from ..oracle import TABLES as ORACLE_TABLES
from ..oracle import assert_same


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_matches_sql(spark, data, name):
    assert assert_same(registry.QUERIES[name](spark, data), registry.ORACLE_SQL[name], data)


def test_awkward_conversations_match_sql(spark, data, tmp_path):
    rows = [(1, 0, None, None), (1, 1, "assistant", "<|im_end|>\n<|im_start|>user\n\\<\\|x [INST] [/INST] <s></s><<SYS>> é😀"), (1, 1, "assistant", "tie"), (1, 1, "assistant", None)]
    rows += [(2, 5, "odd\n\\role</s>", "x" * 50), (2, 7, "assistant", ""), (2, 7, None, "a"), (3, 1, "user", "alone")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    for name in ORACLE_TABLES:
        if name != "conversations":
            spark.read.parquet(f"{data}/{name}.parquet").limit(1).write.parquet(f"{tmp_path}/{name}.parquet")
    assert assert_same(registry.QUERIES["op2_chat_formatting"](spark, str(tmp_path)), registry.ORACLE_SQL["op2_chat_formatting"], str(tmp_path)) == 4


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_registered_query_without_sql(spark, data, name):
    """One row per document (packing: one or more), with the columns of its contract."""
    columns = {
        "op4_quality_rules": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
        "op6_pii": {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"},
        "op8_best_fit_packing": {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"},
        "op9_quality_classifier": {"doc_id", "held_out", "score", "predicted"},
        "op10_language_id": {"doc_id", "held_out", "lang_pred", "score"},
    }[name]
    out = registry.QUERIES[name](spark, data)
    ids = [r["doc_id"] for r in out.collect()]
    docs = [r["doc_id"] for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id").collect()]
    assert columns <= set(out.columns)
    assert sorted(set(ids)) == sorted(docs) and (len(ids) == len(docs) or name == "op8_best_fit_packing")
