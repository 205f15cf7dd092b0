"""Added tokens in a text get the ids that the library gives by default."""

import zlib

from tokenizers import Tokenizer

from placewise.llm import queries


def test_added_tokens_as_the_library_by_default(spark, tmp_path):
    model = Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>y", " <|endoftext|>\n\n c  d <|endoftext| > <|ENDOFTEXT|>", "plain text, it's", "é\t<|endoftext|>　x", "", None]
    rows = list(enumerate(texts))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want, start = [], 0
    for k, t in rows:
        ids = [*model.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((k, start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        start += len(ids)
    assert model.encode(texts[0], add_special_tokens=False).ids == [64, 220, 50256, 275]
    out = queries.QUERIES["op1_token_sequences"](spark, str(tmp_path)).select("doc_id", "start", "n_tokens", "ids_crc32")
    assert sorted(map(tuple, out.collect())) == want
