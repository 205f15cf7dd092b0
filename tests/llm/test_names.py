"""A caller's columns that are named as those used inside stay as they are."""

from placewise.llm import jaccard, pieces, pii, urls
from placewise.llm.queries import on_workers, vocabulary

INSIDE = ["_row", "_k", "_first", "_h", "_base", "_g", "added", "_added", "_done", "_ids", "_rule", "_hits", "h", "t", "base", "component_id"]


def with_names(spark, name, values):
    on_workers(spark)
    rows = [(i, v, *[f"{c}{i}" for c in INSIDE]) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"doc_id long, {name} string, " + ", ".join(f"`{c}` string" for c in INSIDE))


def kept(df):
    rows = df.orderBy("doc_id").collect()
    for r in rows:
        assert [r[c] for c in INSIDE] == [f"{c}{r.doc_id}" for c in INSIDE]
    return rows


def test_jaccard(spark):
    same = "one two three four five six seven eight"
    docs = with_names(spark, "text", [same, same, "other words that stand for themselves here", None, ""])
    out = jaccard.one_of_each(docs)
    assert out.columns == docs.columns and [r.doc_id for r in kept(out)] == [0, 2, 3, 4]


def test_pii(spark):
    out = kept(pii.redact(with_names(spark, "text", ["mail a.b@example.org now", "nothing", None])))
    assert [r.text for r in out] == ["mail [EMAIL] now", "nothing", None]


def test_urls(spark):
    out = kept(urls.judge(with_names(spark, "url", ["http://a.com/en/1", "no url", None]), [("block", "com/en/")]))
    assert [r.verdict for r in out] == ["block", "allow", "allow"]


def test_pieces(spark):
    giant = "some words and more of them " * 3000
    path = vocabulary("piece_bpe_32k.model")
    out = pieces.decode(pieces.encode(with_names(spark, "text", [giant, "short text", None]), path).drop("text"), path)
    assert [r.text for r in kept(out)] == [giant, "short text", ""]
