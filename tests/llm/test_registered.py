"""Queries with SQL against DuckDB, at sf 0.01, and why the others have none."""

import pytest
from compare import DATA, difference, duck
from plumbgrid.llm.queries import QUERIES, SQL

#: What SQL can not say, and the test that stands in for it.
WITHOUT_SQL = {
    "op1_fingerprints": "own hash functions; fingerprints and edits by brute force in test_text_operators",
    "op4_url_filters": "frequent sets of any size; rules by counts of all sets in test_corpus_operators",
    "op5_language": "a trained model; accuracy held out in test_corpus_operators",
    "op6_mixing": "a bisected exponent and permutations; weights and counts in test_corpus_operators",
    "op7_token_ids": "the tokenizer; a round trip in test_corpus_operators",
    "op8_pii": "a trained field; patterns and field by plain versions in test_text_operators",
    "op9_decontamination": "a search in a latent space; planted passages and exact cosines in test_corpus_operators",
    "op13_best_fit_packing": "the tokenizer; a plain best fit in test_bins",
}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, name):
    assert difference(spark, duck(), QUERIES[name], SQL[name], DATA) is None


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(QUERIES) == set(SQL) | set(WITHOUT_SQL) and not set(SQL) & set(WITHOUT_SQL)
