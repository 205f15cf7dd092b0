"""Language identification learns from words of any length."""

import numpy as np
import pytest

from placewise.llm import langid, queries

PATH = queries.vocabulary("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pieces():
    return langid.Pieces(PATH)


def test_languages_without_blanks_are_learnt(spark):
    queries.on_workers(spark)
    spaced = "the house by the river " * 30
    unspaced = "".join(chr(0x4E00 + 37 * k % 400) for k in range(300))
    taught = [(1, spaced, "en"), (2, unspaced, "zh"), (3, "ab" * 400, "xx"), (4, "the", "xx")]
    docs = spark.createDataFrame(taught, "doc_id long, text string, lang string")
    words = {(r["lang"], bytes(r["word"]).decode(), r["n"]) for r in langid.count_words(docs, "text", "lang").collect()}
    assert words == {("en", "the", 60), ("en", "house", 30), ("en", "by", 30), ("en", "river", 30), ("zh", unspaced, 1), ("xx", "ab" * 400, 1), ("xx", "the", 1)}
    model = langid.train(docs, PATH)
    assert model.languages == ["en", "xx", "zh"]
    out = langid.predict(spark.createDataFrame([(1, unspaced[40:90]), (2, "abab" * 9), (3, "the river")], "doc_id long, text string"), model)
    assert sorted((r["doc_id"], r["lang_pred"]) for r in out.collect()) == [(1, "zh"), (2, "xx"), (3, "en")]


def test_expected_counts_of_words_of_any_length(pieces, monkeypatch):
    """Groups, their order and stretches leave the counts as one lattice of all words gives them."""
    logs = np.log(np.random.default_rng(5).dirichlet(np.ones(pieces.size)))
    words, times = [b"the", "überhaus日本".encode() * 40, b"house", b"ab" * 200, "été".encode()], np.array([5, 2, 3, 7, 1])
    data, lengths = np.frombuffer(b"".join(b" " + w for w in words), np.uint8), np.array([len(w) + 1 for w in words])
    whole = langid.Lattice(pieces, data, lengths).expected(logs, times)
    ends = np.cumsum(lengths)
    starts = ends - lengths + 1
    assert np.allclose(langid.expected_counts(pieces, data, starts, ends, times, logs), whole, rtol=1e-9)
    for most in (61, 450, 700):
        monkeypatch.setattr(langid, "PASS", most)
        assert np.allclose(langid.expected_counts(pieces, data, starts, ends, times, logs), whole, rtol=1e-9)
