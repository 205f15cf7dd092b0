"""Stretches of one bucket are told apart by their whole content hash."""

from placewise.llm import queries, repeats
import brute


def test_equal_upper_halves_of_content_are_no_repeat(spark):
    queries.on_workers(spark)
    texts = ["vhgmolzbkbywxfsieafrclvlfllaygthqoyduixjfcecdwgurq", "jyxfofubwplwsfsieafrclvlfllaygthqoyduphlihylwgbiuf"]
    rows = list(enumerate([*texts, texts[0]]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = repeats.dedupe(docs).select("doc_id", "n_removed").collect()
    want = [(k, gone) for k, _, gone, *_ in brute.repeats(rows)]
    assert want == [(0, 0), (1, 0), (2, 50)]
    assert sorted(map(tuple, out)) == want
    assert sorted(map(tuple, repeats.dedupe(docs.coalesce(1)).select("doc_id", "n_removed").collect())) == want
