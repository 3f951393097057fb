from lodestone.llm import token_counts
from lodestone.llm.common import documents


def test_counts_are_the_librarys(spark, sf, odd_documents):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(token_counts.vocabulary_path())
    for docs in (documents(spark, sf), odd_documents):
        got = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(docs).collect())
        want = []
        for r in docs.collect():
            n = len(tokenizer.encode(r.text or "", add_special_tokens=False).ids)
            want.append((r.doc_id or -1, len((r.text or "").encode()), n, n > 1024))
        assert got == sorted(want)
        assert token_counts.token_counts(docs.limit(0)).count() == 0


def test_recent_code_points_go_to_the_library():
    split = token_counts.Splitter()
    assert split("a \U00010940b") is None and split("x <|endoftext|>") is None
    assert split("a  b café") == ["a", " ", " b", " café"]


def test_cache_is_bounded(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_counts, "CACHE_SIZE", 5)
    lengths = token_counts.PreTokenLengths(Tokenizer.from_file(token_counts.vocabulary_path()), {"the": 1})
    for k in range(40):
        assert lengths[f"w{k}"] >= 1
    assert len(lengths) <= 6 and lengths["the"] == 1
