"""Every registered training-data query at a small size: columns, types and rows."""

import pytest

SMALL = "/root/testdata/sf0.001"
#: query: (table, key, one row per key, (column, type) pairs that the contract names)
CONTRACTS = {
    "op1_ngram_join": ("documents", "doc_id", True, [("doc_id", "bigint"), ("n_shingles", "bigint"), ("component_id", "bigint")]),
    "op2_quality_rules": ("documents", "doc_id", True, [("doc_id", "bigint"), *[(c, "bigint") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
                                                         ("base_failed", "boolean"), ("kept", "boolean")]),
    "op3_packing": ("documents", "doc_id", False, [(c, "bigint") for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]),
    "op4_vector_graph": ("embeddings", "vec_id", True, [("vec_id", "bigint"), ("n_links", "bigint"), ("component_id", "bigint"), ("kept", "boolean")]),
    "op5_pii": ("documents", "doc_id", True, [("doc_id", "bigint"), *[(f"n_{k}", "bigint") for k in ("email", "ip", "card", "phone")], ("base_sha256", "string"), ("spans", "string")]),
    "op6_language_model": ("documents", "doc_id", True, [("doc_id", "bigint"), ("held_out", "boolean"), *[(c, "bigint") for c in ("n_tokens", "n_known", "train_tokens")],
                                                          ("base_score", "double"), ("score", "double")]),
    "op7_html_text": ("pages", "page_id", True, [("page_id", "bigint"), ("url", "string"), ("text", "string"), ("n_chars", "bigint")]),
    "op8_bpe": ("documents", "doc_id", True, [("doc_id", "bigint"), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")]),
    "op9_nbsvm": ("documents", "doc_id", True, [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]),
    "op10_license_scan": ("documents", "doc_id", True, [("doc_id", "bigint")]),
    "op11_exact_dedup": ("documents", "doc_id", True, [("doc_id", "bigint"), ("keep_id", "bigint"), ("group_size", "bigint"), ("kept", "boolean"), ("text_sha256", "string")]),
    "op12_conversations": ("conversations", "conv_id", False, [("conv_id", "bigint"), *[(c, "bigint") for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                                                                ("audit", "string"), ("repaired_sha256", "string")]),
    "op13_hard_negatives": ("embeddings", None, False, [(c, "int" if c == "rank" else "bigint") for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")]),
}


def test_one_query_per_operator():
    import __spark_entry__ as E
    assert set(CONTRACTS) | {"pipeline"} == {n for n in E.queries() if n.startswith("op") and n[2].isdigit() or n == "pipeline"}


@pytest.mark.parametrize("name", sorted(CONTRACTS))
def test_query_meets_contract(llm, name):
    from tavola.llm.queries import QUERIES
    table, key, single, columns = CONTRACTS[name]
    got = QUERIES[name](llm, SMALL)
    kinds = dict(got.dtypes)
    assert [(c, kinds.get(c)) for c, _ in columns] == columns
    if key is None:  # some keys give no rows
        return
    keys = [r[key] for r in got.select(key).collect()]
    want = [r[key] for r in llm.read.parquet(f"{SMALL}/{table}.parquet").select(key).collect()]
    assert sorted(keys) == sorted(want) if single else set(keys) == set(want)
    nulls = got.select([c for c, _ in columns]).where(" or ".join(f"`{c}` is null" for c, _ in columns)).count()
    assert nulls == 0
