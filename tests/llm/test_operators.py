"""Each operator beside a plain version, on small tables with nulls, empty and repeated rows and clashing columns."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from placewise.llm import components, decontaminate, embeddings, jaccard, pieces, pii, queries, repeats, sharding, tokens, toxicity, urls
import brute

WORDS = "the of and river stone house wind cloud green letter seven music paper night water silver road".split()
FIELDS = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "x1", ","]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    passage, long = sentence(rng, 60), sentence(rng, 400)
    out = [sentence(rng, rng.choice([1, 3, 4, 5, 30, 120])) for _ in range(25)]
    out += [None, "", " ", "\n\t ", "é", out[6], out[6], out[6].upper(), long, long + " end", "start " + long, long.replace("river", "rivers", 2)]
    out += [sentence(rng, 20) + "\n" + passage + " " + sentence(rng, 20) for _ in range(6)] + ["ab" * 90, "x" + "ab" * 70, "é" * 80, "ü" + "é" * 60]
    near = sentence(rng, 90).split()
    for k in range(12):
        copy = list(near)
        copy[k], copy[-k - 1] = "edit", "other"
        out.append(" ".join(copy))
    return [(k, t, "en", "s", len(t or "")) for k, t in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    queries.on_workers(spark)
    return spark.createDataFrame(rows, FIELDS).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], FIELDS)


def taken(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=lambda r: tuple((v is not None, v) for v in r))


def pairs(rows):
    return [(k, t) for k, t, *_ in rows]


def test_tokens(spark, docs, rows, none, tmp_path):
    path = queries.vocabulary("byte_bpe_50k.json")
    odd = [(100, "a  b\n\n c\t d's I'll <|endoftext|> x　y ", "en", "s", 0), (None, "no key", "en", "s", 0), (7, "again", "en", "s", 0)]
    both = docs.unionByName(spark.createDataFrame(odd, FIELDS))
    folder = f"file://{tmp_path}/shards"
    manifest = tokens.write_sequences(both, path, folder, end=2, length=16, batch=4)
    found = tokens.read_sequences(spark, folder, manifest)
    assert taken(found, "doc_id", "start", "n_tokens", "ids_crc32") == sorted(brute.tokens(pairs(rows + odd), path, 2), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    file = tokens.SequenceFile.map(manifest[0]["sequences"])
    stream = pa.ipc.open_stream(manifest[0]["sequences"]).read_all()
    assert stream.schema.field("ids").type.list_size == 16
    for n in (0, stream.num_rows // 2, stream.num_rows - 1):
        ids, mask = file[n]
        assert ids.tolist() == stream.column("ids")[n].as_py() and mask.tolist() == stream.column("mask")[n].as_py()
    with pytest.raises(IndexError):
        file[stream.num_rows]
    assert tokens.token_table(none, path, 2).count() == 0


def test_pieces_equal_the_library_and_come_back(docs, rows, none, monkeypatch):
    path = queries.vocabulary("piece_bpe_32k.model")
    model = pieces.model(path)
    encoded = pieces.encode(docs.withColumn("ids", F.lit("clash")), path)
    assert taken(pieces.decode(encoded, path), "doc_id", "text") == [(k, t or "") for k, t in pairs(rows)]
    assert pieces.encode(none, path).count() == 0
    whole = dict(taken(encoded, "doc_id", "ids"))
    monkeypatch.setattr(pieces, "CHUNK", 40)
    monkeypatch.setattr(pieces, "FAN", 3)
    cut = dict(taken(pieces.encode(docs, path), "doc_id", "ids"))
    score = lambda ids: sum(v for i in ids for v in [back.get(i)] if v is not None)
    back = {i: model.scores[p] for p, i in model.piece_ids.items()}
    for k in whole:
        assert score(whole[k]) == score(cut[k]) and model.decode(np.array(cut[k], np.int64)) == (rows[k][1] or "")


def test_chunk_matrices_multiply_to_the_whole():
    model = pieces.model(queries.vocabulary("piece_bpe_32k.model"))
    for text in ("▁abcdefgh" * 9, "▁the▁river▁stone" * 8, "z" * 100, "▁▁▁a▁▁" * 12, "▁日本é😀" * 20):
        for size in (16, 33):
            parts = [(text[k : k + size + model.width - 1], min(size, len(text) - k)) for k in range(0, len(text), size)]
            matrices = [model.matrix(*p) for p in parts]
            total = matrices[0]
            for m in matrices[1:]:
                total = pieces.product(total, m)
            assert total[0, 0] == model.path_score(text)
            ids = sum((model.trace(*p, *s) for p, s in zip(parts, pieces.hand_down(matrices, 0, 0))), [])
            assert model.decode(np.array(ids)) == text.replace("▁", " ")[1:]


def test_shards(spark, docs, rows, none):
    again = docs.unionByName(docs).withColumn("shard", F.lit("clash"))
    out = [r.asDict() for r in sharding.shard(again, 7).select("doc_id", "shard", "slot").collect()]
    assert sorted(r["doc_id"] for r in out) == sorted(2 * [r[0] for r in rows])
    slots = {}
    for r in out:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert sharding.shard(none, 3).count() == 0


def test_communication_matrix_keeps_its_margins_and_mean():
    total = np.zeros((3, 2))
    for seed in range(600):
        m = np.array(sharding.communication_matrix([10, 20, 5], [17, 18], seed))
        assert m.sum(axis=1).tolist() == [10, 20, 5] and m.sum(axis=0).tolist() == [17, 18]
        total += m
    assert np.abs(total / 600 - np.outer([10, 20, 5], [17, 18]) / 35).max() < 0.25
    big = sharding.hypergeometric(random.Random(1), 3 * 10**10, 7 * 10**10, 10**9)
    assert abs(big - 3 * 10**8) < 10**5


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "TILE", 4)
    queries.on_workers(spark)
    rng = np.random.default_rng(3)
    base = rng.standard_normal((6, 16))
    rows = [(k, (base[k % 6] + rng.standard_normal(16) * (0.1 if k % 3 else 0.0)).tolist(), int(k % 6 == 5)) for k in range(60)]
    rows += [(60, None, 0), (61, [0.0] * 16, 0), (62, [float("nan")] * 16, 0), (63, [1.0, None], 0), (64, rows[0][1], None), (65, [], 0), (66, [1.0], 0), (67, [2.0], 0)]
    out = {r["vec_id"]: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    union, links = brute.Union(), dict.fromkeys(range(68), 0)
    for a in range(68):
        union.find(a)
        for b in range(a):
            x, y = rows[a][1], rows[b][1]
            if 60 <= a < 66 or 60 <= b < 66 or len(x) != len(y) or rows[a][2] != rows[b][2]:
                continue
            if np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93:
                union.join(a, b)
                links[a] += 1
                links[b] += 1
    assert len(out) == 68
    for k, r in out.items():
        assert (r["n_links"], r["component_id"], r["kept"]) == (links[k], union.find(k), union.find(k) == k)
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<double>, label int")).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(None, 3), (400, 400)] + [(500 + k, 501 + k) for k in range(40)]
    union = brute.Union()
    for a, b in edges:
        if a is not None and a != b:
            union.join(a, b)
    out = components.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b")
    assert taken(out, "node", "component") == sorted((x, union.find(x)) for x in union.up)


TEXTS = [
    None, "", "a@b.c", "x a@b.co_d@e.fr a@b c@@d.e .a@b.c", "1.2.3.4 999.1.1.1 1.2.3.4.5.6.7.8 0001.2.3.4 1.2.3", "4524132264652876 4524 1322-6465 2876 4524132264652877 1",
    "+1 (988) 555-2485, +12 +1((((( +1-2-3-4-5-6-7-8-9 +1+123456789012", "a" * 3000, "a" * 2000 + "@" + "b." * 2000, "9" * 5000, "1 " * 3000, "é 12.1.1.1 ü a@b.cd é", "x" * 50 + "+1 555 555 5555",
]


def test_pii_patterns(spark, none):
    queries.on_workers(spark)
    rows = [(k, t) for k, t in enumerate(TEXTS)]
    out = pii.report(spark.createDataFrame(rows, "doc_id long, text string"))
    assert taken(out, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == sorted(brute.pii(rows))
    assert pii.report(none).count() == 0


def test_pii_finds_unseen_identifiers_and_redacts(spark):
    rows = [(k, f"Please call our desk on +1 (555) 010-{1000 + k} today") for k in range(8)] + [(8, "Please call our desk on 555-010-7788 today"), (9, "built in 1999-2004 by hand"), (10, None), (11, "mail a@b.cd now")]
    df = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in rows], FIELDS)
    spans = dict(taken(pii.report(df), "doc_id", "spans"))
    assert spans[8] == "phone:24:36" and spans[9] == "" and spans[10] == ""
    clean = dict(taken(pii.redact(df), "doc_id", "text"))
    assert clean[0] == clean[8] == "Please call our desk on [PHONE] today" and clean[9] == rows[9][1] and clean[10] is None and clean[11] == "mail [EMAIL] now"


@pytest.mark.parametrize("hot", [64, 3])
def test_jaccard(spark, docs, rows, none, monkeypatch, hot):
    monkeypatch.setattr(jaccard, "HOT", hot)
    monkeypatch.setattr(jaccard, "TILE", 4)
    out = jaccard.classes(docs)
    want = brute.jaccard(pairs(rows))
    assert taken(out, "doc_id", "n_shingles", "component_id") == sorted(want)
    kept = {c if n else k for k, n, c in want}
    assert [r[0] for r in taken(jaccard.one_of_each(docs), "doc_id")] == sorted(kept)
    assert jaccard.classes(none).count() == 0


def test_adaptive_prefixes_lose_no_pair():
    rng = np.random.default_rng(4)
    sketch = np.zeros(jaccard.SKETCH, np.int32)
    sketch[: jaccard.SKETCH // 2] = rng.integers(0, 500, jaccard.SKETCH // 2)
    for _ in range(200):
        common = rng.integers(0, 2**63, rng.integers(1, 80)).astype(np.uint64)
        sets = [np.unique(np.concatenate([common, rng.integers(0, 2**63, rng.integers(0, 12)).astype(np.uint64)])) for _ in range(2)]
        both = len(np.intersect1d(*sets))
        if 100 * both < 75 * (sum(map(len, sets)) - both):
            continue
        (a, m, base_a), (b, k, base_b) = (jaccard.adaptive_prefix(s, sketch, 75) for s in sets)
        m = min(m, k)
        assert len(np.intersect1d(a[: base_a + m - 1], b[: base_b + m - 1])) >= m


def test_urls(spark):
    queries.on_workers(spark)
    rows = [(0, None), (1, "no scheme/x"), (2, "http://A.Example.COM/en/7?x"), (3, "http://x.com/en/9#a"), (4, "http://best-casino.org/x"), (5, "http://a.org/casinoroyale"), (6, "http://free.win.org/"), (7, "http://free.org/freedom"), (8, ""), (9, "https://"), (10, "http://b.net/de/8"), (11, "http://example.net/de/81")]
    out = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string").withColumn("rule", F.lit("clash")), queries.RULES).collect()}
    assert out[0] == out[1] == out[8] == out[9] == ("", "", None, "allow")
    assert out[2] == ("a.example.com", "/en/7", "example.com/en/7", "allow") and out[3] == ("x.com", "/en/9", "com/en/", "block")
    assert [out[k][3] for k in (4, 5, 6, 7, 10, 11)] == ["block", "allow", "block", "allow", "allow", "block"]


def test_url_query_agrees_with_its_sql(spark):
    import duckdb

    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet'")
    got = queries.QUERIES["op7_url_filter"](spark, folder)
    want = con.sql(queries.SQL["op7_url_filter"])
    assert taken(got, *want.columns) == sorted(want.fetchall(), key=lambda r: tuple((v is not None, v) for v in r))


def test_string_tiles():
    a, b = np.arange(1, 41, dtype=np.uint64), np.r_[np.arange(21, 41), [99], np.arange(1, 21)].astype(np.uint64)
    assert sorted(decontaminate.tiles(a, b)) == [(0, 21, 20), (20, 0, 20)]
    assert decontaminate.tiles(a[:4], b) == [] and decontaminate.tiles(a, a) == [(0, 0, 40)]


def test_decontamination(spark, docs, none):
    item = [f"w{k}" for k in range(30)]
    texts = ["lead " + " ".join(item).upper() + " tail", " ".join(item[15:] + ["gap"] + item[:15]), " ".join(item[:20]), None, "", " ".join(item[:15]) + " x " + " ".join(item[15:27])]
    extra = spark.createDataFrame([(200 + k, t, "en", "s", 0) for k, t in enumerate(texts)], FIELDS)
    items = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, ""), (4, "two words")], "item_id long, text string")
    both = docs.unionByName(extra)
    out = {r["doc_id"]: r["contaminated"] for r in decontaminate.report(both, items).collect()}
    assert [k for k, bad in sorted(out.items()) if bad] == [200, 201, 205]
    left = {r["doc_id"] for r in decontaminate.remove(both, items).collect()}
    assert left == set(out) - {200, 201, 205}
    assert decontaminate.report(none, items).count() == 0 and decontaminate.remove(docs, items.limit(0)).count() == docs.count()


@pytest.mark.parametrize("bucket", [4096, 2])
def test_repeats(docs, rows, none, monkeypatch, bucket):
    monkeypatch.setattr(repeats, "BUCKET", bucket)
    out = repeats.dedupe(docs).withColumn("sha", F.sha2("kept", 256))
    assert taken(out, "doc_id", "n_bytes", "n_removed", "n_spans", "sha") == sorted(brute.repeats(pairs(rows)))
    assert repeats.dedupe(none).count() == 0


def test_maximal_repeats_have_all_occurrences():
    rng = random.Random(8)
    common = bytes(rng.randrange(97, 123) for _ in range(60))
    strings = [b"1" + common + b"2", b"3" + common + b"2x", b"4" + common[:55] + b"5", b"nothing here"]
    found = {(size, tuple(sorted(zip(s.tolist(), p.tolist())))) for size, s, p in repeats.maximal_repeats(strings, 50)}
    assert found == {(61, ((0, 1), (1, 1))), (55, ((0, 1), (1, 1), (2, 1)))}


def test_toxicity(spark, none, tmp_path):
    queries.on_workers(spark)
    folder, rng = f"file://{tmp_path}", random.Random(12)
    parts = "ba ke lo mi nu ra se ti vo za chi dra fen gor hul".split()
    ordinary = ["".join(rng.choice(parts) for _ in range(rng.randint(2, 4))) for _ in range(1500)]
    toxic = ["".join(rng.choice("grk vex wuz pid sko yab".split()) for _ in range(rng.randint(2, 3))) for _ in range(24)]
    made = []
    for k in range(3000):
        words = rng.choices(ordinary, k=rng.randint(20, 90))
        if k % 9 == 0:
            for _ in range(rng.randint(3, 7)):
                words.insert(rng.randrange(len(words)), rng.choice(toxic))
        made.append((k, " ".join(words), int(k % 9 == 0)))
    made = spark.createDataFrame(made, "doc_id long, text string, toxic int")
    made.drop("toxic").write.parquet(f"{folder}/documents.parquet")
    made.drop("text").write.parquet(f"{folder}/labels.parquet")
    out = queries.QUERIES["op10_toxicity"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out")
    rows = out.select("toxic", "score", "predicted").collect()
    good = sum(r["toxic"] == r["predicted"] for r in rows) / len(rows)
    caught = [r["predicted"] for r in rows if r["toxic"]]
    assert good > 0.99 and sum(caught) / len(caught) > 0.95 and all(0 <= r["score"] <= 1 for r in rows)
    model = toxicity.train(none, spark.createDataFrame([], "doc_id long, toxic int"))
    odd = spark.createDataFrame([(1, None, "en", "clash"), (2, "", "en", "x")], "doc_id long, text string, lang string, score string")
    assert [r["score"] for r in toxicity.score(odd, model).collect()] == [0.5, 0.5]


def test_crc_of_round_trip_query(spark):
    rows = queries.QUERIES["op2_sentencepiece"](spark, "/root/testdata/sf0.001").collect()
    texts = dict(tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect())
    assert all(r["round_trip"] and r["text_crc32"] == zlib.crc32((texts[r["doc_id"]] or "").encode()) for r in rows)


def test_pipeline_against_plain_versions(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    queries.on_workers(spark)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    kept = corpus_pipeline.toxicity_filter(spark, docs, folder).cache()
    assert kept.columns == columns and kept.count() <= docs.count()
    rows = [tuple(r) for r in kept.select("doc_id", "text").collect()]
    single = corpus_pipeline.near_duplicates(spark, kept, folder).cache()
    want = brute.jaccard(rows)
    assert {r["doc_id"] for r in single.collect()} == {k for k, n, c in want if not n or k == c} and single.columns == columns
    clean = corpus_pipeline.benchmark_leaks(spark, single, folder).cache()
    items = [brute.shingle_set(r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    leaked = {r["doc_id"] for r in single.collect() if any(i and len(i & brute.shingle_set(r["text"])) == len(i) for i in items)}
    assert {r["doc_id"] for r in single.collect()} - {r["doc_id"] for r in clean.collect()} >= leaked and clean.columns == columns
    safe = corpus_pipeline.personal_data(spark, clean, folder)
    assert safe.columns == columns and not any(brute.base_spans(r["text"]) for r in safe.collect())
    done = corpus_pipeline.run(spark, folder)
    assert done.count() == clean.count() and set(done.columns) == (set(columns) - {"text"}) | {"ids", "n_tokens"}
