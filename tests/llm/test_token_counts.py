"""Token counts against the tokenizer."""

from lumispan.llm import token_counts

from .test_corpus_operators import TOKENIZER, documents, ids_of


def test_token_counts(spark, edges, no_rows):
    for docs in (documents(spark), edges):
        sizes = [len(x) - 1 for x in ids_of([r["text"] for r in docs.select("text").collect()])]
        out = token_counts.token_counts(docs, TOKENIZER).collect()
        assert sorted(r["length"] for r in out) == sorted(set(sizes))
        for r in out:
            n = r["length"]
            assert r["n_docs"] == sizes.count(n) and r["n_longer"] == sum(s > n for s in sizes)
            assert r["total_tokens"] == sum(s for s in sizes if s <= n) and r["truncated_total"] == sum(min(s, n) for s in sizes)
            assert abs(r["quantile"] - sum(s <= n for s in sizes) / len(sizes)) < 1e-12
    assert token_counts.token_counts(no_rows, TOKENIZER).count() == 0
