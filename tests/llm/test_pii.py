"""Identifiers found by bootstrapping, candidates of any length, many spans in one text."""

import brute

from placewise.llm import pii

FIELDS = "doc_id long, text string"


def spans(spark, texts):
    made = pii.report(spark.createDataFrame(list(enumerate(texts)), FIELDS))
    return {r["doc_id"]: r["spans"] for r in made.select("doc_id", "spans").collect()}


def test_keys_and_spelled_addresses(spark):
    seeds = [f'then token = "{k:02x}{"9f3a" * 10}" of' for k in range(16, 26)] + [f"write to our office mail ann{k}@host.org soon" for k in range(8)]
    long = "x7" * 300
    other = ['set token="ghq_Zz81Kp20Qm77Lw5" here', f'then token = "{long}" of', "write to our office mail bob (at) host.org soon", f"commit {'9f3a' * 10} was kept", "版本" * 50 + "2024年12月" * 40, None, ""]
    out = spans(spark, seeds + other)
    n = len(seeds)
    assert all(out[k] == "key:14:56" for k in range(10))
    assert out[n] == "key:11:30" and out[n + 1] == "key:14:614" and out[n + 2] == "email:25:42"
    assert [out[n + k] for k in (3, 4, 5, 6)] == ["", "", "", ""]


def test_candidates_that_overlap_an_entity_go(spark):
    """More spans than are folded at once, on both sides of the border between pieces."""
    text = " ".join(f"a{k}@b.cd 4{k:04d}" for k in range(2 * pii.AT_ONCE))
    row = spark.createDataFrame([(1, text)], "h long, t string").select("h", "t", pii.base_spans(pii.F.col("t")).alias("base"))
    found = pii.occurrences(row).collect()
    assert sum(r["kind"] == 0 for r in found) == sum(r["kind"] is None for r in found) == 2 * pii.AT_ONCE
    assert sorted(text[r["start"] : r["stop"]] for r in found) == sorted(text.split(" "))


def test_many_addresses_in_one_text(spark):
    text = "é" + " ".join(f"a{k}@b.cd" for k in range(1500)) + " end"
    df = spark.createDataFrame([(1, text)], FIELDS)
    assert pii.report(df).first()["spans"] == ",".join(f"{k}:{a}:{b}" for k, a, b in brute.base_spans(text))
    assert pii.redact(df).first()["text"] == "é" + " ".join(["[EMAIL]"] * 1500) + " end"


def test_byte_order_marks_stay(spark):
    df = spark.createDataFrame([(1, "\ufeffx a@b.cd\ufeff\U0001f600 e@f.gh")], FIELDS)
    assert pii.redact(df).first()["text"] == "\ufeffx [EMAIL]\ufeff\U0001f600 [EMAIL]"
