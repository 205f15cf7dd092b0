"""Language identification, hard negatives and collocations beside plain versions."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from placewise.llm import collocations, langid, negatives, queries

PATH = queries.vocabulary("piece_bpe_32k.model")
FIELDS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(autouse=True)
def workers(spark):
    queries.on_workers(spark)


# --- language identification -------------------------------------------------------------------------


@pytest.fixture(scope="module")
def pieces():
    return langid.Pieces(PATH)


def every_segmentation(pieces, word, logs):
    """Summed probability of all segmentations, by recursion over the pieces themselves."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    if not hasattr(every_segmentation, "ids"):
        proto = pb.ModelProto()
        proto.ParseFromString(open(PATH, "rb").read())
        kind = pb.ModelProto.SentencePiece
        ids = {bytes([int(p.piece[1:-1], 16)]): i for i, p in enumerate(proto.pieces) if p.type == kind.BYTE}
        every_segmentation.ids = ids | {p.piece.replace("▁", " ").encode(): i for i, p in enumerate(proto.pieces) if p.type == kind.NORMAL}
    ids, raw = every_segmentation.ids, b" " + word

    def to(end):
        return 1.0 if end == 0 else sum(to(a) * math.exp(logs[ids[raw[a:end]]]) for a in range(end) if raw[a:end] in ids)

    return to(len(raw))


def test_forward_sums_all_segmentations(pieces):
    logs = np.log(np.random.default_rng(1).dirichlet(np.ones(pieces.size)))
    words = [w.encode() for w in "the house l'été straße über a antidis 日本 ẞ zq".split()]
    data, lengths = np.frombuffer(b"".join(b" " + w for w in words), np.uint8), np.array([len(w) + 1 for w in words])
    got = langid.word_scores(pieces, data, lengths, logs[:, None])[:, 0]
    assert np.allclose(got, [math.log(every_segmentation(pieces, w, logs)) for w in words], rtol=1e-12)


def test_expected_counts(pieces):
    """Counts weighed by length add up to the bytes of the words, and one piece's count is its share of the probability."""
    logs = np.log(np.random.default_rng(2).dirichlet(np.ones(pieces.size)))
    words, times = [b" house", b" the", b" \xc3\xa9t\xc3\xa9"], np.array([3, 5, 2])
    lattice = langid.Lattice(pieces, np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words]))
    counts = lattice.expected(logs, times)
    length = np.zeros(pieces.size)
    length[lattice.ids] = lattice.end - lattice.start
    assert np.isclose((counts * length).sum(), sum(len(w) * n for w, n in zip(words, times)))
    at = np.flatnonzero((lattice.word == 1) & (lattice.end - lattice.start == 4))
    assert np.isclose(counts[lattice.ids[at[0]]], 5 * math.exp(logs[lattice.ids[at[0]]]) / every_segmentation(pieces, b"the", logs))


def test_a_very_long_word_is_scored_in_stretches(pieces, monkeypatch):
    logs = np.log(np.random.default_rng(3).dirichlet(np.ones(pieces.size), 2).T)
    word = np.frombuffer(b" " + "überhaus日本".encode() * 40, np.uint8)
    whole = langid.word_scores(pieces, word, np.array([len(word)]), logs)
    monkeypatch.setattr(langid, "PASS", 61)
    assert np.allclose(langid.word_scores(pieces, word, np.array([len(word)]), logs), whole, rtol=1e-12)


def test_languages_held_out(spark):
    out = queries.QUERIES["op11_language_id"](spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = out.join(docs, "doc_id").collect()
    held = [r for r in rows if r["held_out"] and r["lang"] is not None]
    assert len(rows) == docs.count() and len(held) > 200
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_odd_texts(spark):
    taught = [(i, t, n) for i, (t, n) in enumerate([("the house and the river", "en"), ("das haus und der fluss", "de"), (None, "fr"), ("le", None)] * 3)]
    model = langid.train(spark.createDataFrame(taught, "doc_id long, text string, lang string"), PATH)
    assert model.languages == ["de", "en"]
    odd = [(1, None, 0, "x"), (2, "", 1, "x"), (3, " 12 !? ", 2, "x"), (4, "DAS HAUS", 3, "x"), (5, "the river", 4, "x"), (5, "the river", 4, "x"), (6, "the river " * 20_000, 5, "x"), (None, "der fluss", 6, "x")]
    docs = spark.createDataFrame(odd, "doc_id long, text string, score int, lang_pred string")
    out = langid.predict(docs, model)
    got = sorted((r["doc_id"] or 0, r["lang_pred"]) for r in out.collect())
    assert got == [(0, "de"), (1, "und"), (2, "und"), (3, "und"), (4, "de"), (5, "en"), (5, "en"), (6, "en")]
    assert langid.predict(docs.limit(0), model).count() == 0
    nothing = langid.train(docs.limit(0).withColumn("lang", F.lit("en")), PATH)
    assert nothing.languages == [] and {r["lang_pred"] for r in langid.predict(docs, nothing).collect()} == {"und"}
    extra = docs.withColumns({"word": F.lit(1), "n": F.lit(2), "held_out": F.lit(3), "id": F.lit(4)})
    assert set(langid.predict(extra, model).columns) == set(extra.columns)


# --- hard negatives ----------------------------------------------------------------------------------


def plain_negatives(rows, asked, positives=5, negatives=10):
    whole = {}
    for key, label, v in sorted((r for r in rows if r[0] is not None and r[1] is not None and r[2]), key=lambda r: (r[0], r[1])):
        if all(x is not None and math.isfinite(x) for x in v):
            whole.setdefault(key, (label, [math.floor(256 * x) for x in v]))
    out = []
    for key, (label, v) in whole.items():
        if not asked(key):
            continue
        scored = [(sum(a * b for a, b in zip(v, w)), k, g) for k, (g, w) in whole.items() if k != key and len(w) == len(v)]
        scored.sort(key=lambda s: (-s[0], s[1]))
        for p, pid, _ in [s for s in scored if s[2] == label][:positives]:
            found = [s for s in scored if s[2] != label and 30 * p <= 100 * s[0] <= 90 * p][:negatives]
            out += [(key, pid, i + 1, s[1], p, s[0]) for i, s in enumerate(found)]
    return sorted(out)


def vectors(rng, n, dim, scale=1.0):
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(4)]
    return [(k, rng.randrange(4), [scale * (c + rng.gauss(0, 0.7)) for c in centres[rng.randrange(4)]]) for k in range(n)]


@pytest.mark.parametrize("scale", [0.01, 1.0, 40_000.0])
def test_negatives(spark, scale, monkeypatch):
    rng = random.Random(4)
    rows = vectors(rng, 300, 24, scale)
    rows += [(300, 1, None), (310, None, rows[0][2]), (320, 2, []), (330, 2, [float("nan")] * 24), (340, 2, [1.0, None] * 12), (None, 1, rows[1][2])]
    rows += [(350 + k, k % 4, rows[0][2]) for k in range(40)] + [rows[3], rows[10], (400, 1, [0.0] * 24), (410, 1, [1.0] * 3), (420, 2, [0.5] * 3)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumns({"id": F.lit("x"), "score": F.lit(1), "anchor": F.lit(2), "v": F.lit(3)})
    want = plain_negatives(rows, lambda k: k % 10 == 0)
    for block in (4096, 7):
        monkeypatch.setattr(negatives, "ANCHORS", block)
        monkeypatch.setattr(negatives, "ROWS", 2 * block)
        out = negatives.mine(df.repartition(3), F.col("vec_id") % 10 == 0)
        assert sorted(tuple(r) for r in out.collect()) == want and len(want) > 500
    assert negatives.mine(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    assert negatives.mine(df, F.lit(False)).count() == 0


def test_products_are_exact():
    rng = np.random.default_rng(6)
    for most in (3, 300, 2**20, 2**29):
        a, b = rng.integers(-most, most + 1, (5, 2500)), rng.integers(-most, most + 1, (4, 2500))
        exact = [[sum(int(x) * int(y) for x, y in zip(r, s)) for s in b] for r in a]
        bound = max(int((m.astype(object) ** 2).sum(axis=1).max()) for m in (a, b))
        if bound >= 2**62:
            a, b, exact = a[:, :4], b[:, :4], [[sum(int(x) * int(y) for x, y in zip(r[:4], s[:4])) for s in b] for r in a]
            bound = max(int((m.astype(object) ** 2).sum(axis=1).max()) for m in (a, b))
        primes = negatives.primes_for(bound)
        assert negatives.products(negatives.residues(a, primes), negatives.residues(b, primes), primes).tolist() == exact


def test_shares_near_the_end_of_64_bits():
    top = 2**62 - 1
    scores = np.array([top, -top, 0, 7, 10, 99])
    assert negatives._share(scores, 30, True).tolist() == [-(-30 * int(s) // 100) for s in scores]
    assert negatives._share(scores, 90, False).tolist() == [90 * int(s) // 100 for s in scores]


def test_vectors_too_long_for_a_long_take_no_part(spark):
    rows = [(0, 1, [1e12, 0.0]), (10, 1, [1.0, 1.0]), (11, 1, [1.0, 0.9]), (12, 2, [0.5, 0.5])]
    out = negatives.mine(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"), F.col("vec_id") % 10 == 0)
    assert {r["anchor_id"] for r in out.collect()} == {10}


# --- collocations ------------------------------------------------------------------------------------


def plain_collocations(rows, least, share=80, most=2000):
    counts, total = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(words)
            for m in range(1, 5):
                counts.setdefault(lang, Counter()).update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in found.items():
            inside = (q for q in found if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)))
            if any(100 * found[q] >= share * a for q in inside):
                continue
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            kept.append((lang, " ".join(p), a, f[p[:k]], f[p[k:]], total[lang], score))
        kept.sort(key=lambda r: (-r[6], -r[2], r[1].encode()))
        out += [(r[0], i + 1, *r[1:]) for i, r in enumerate(kept[:most])]
    return sorted(out)


def texts(rng, n):
    words = "new york city of the great wall Straße été house river 日本".split()
    fixed = ["new york city hall", "the great wall of", "as far as we know"]
    return [(rng.choice(["en", "de", None]), " ".join(rng.choice(fixed) if rng.random() < 0.2 else rng.choice(words) + rng.choice(["", "", "", ",", ".\n", "  ", "\t;"]) for _ in range(rng.randrange(60)))) for _ in range(n)]


@pytest.mark.parametrize("budget", [1 << 20, 300, 20])
def test_collocations(spark, budget):
    rng = random.Random(9)
    rows = texts(rng, 150) + [("en", None), ("en", ""), (None, " .;\n "), ("en", "same words again " * 3_000), ("de", "x"), ("de", "x"), ("en", "lone\x00word \x0bnext")]
    df = spark.createDataFrame(rows, "lang string, text string").withColumns({c: F.lit(7) for c in ("h", "n", "w", "f", "rank", "score", "word", "group")}).repartition(4)
    want = plain_collocations(rows, 8)
    out = collocations.mine(df, least=8, budget=budget)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in out.collect()) == want and len(want) > 60
    first = collocations.mine(df, least=8, budget=budget, most=5)
    assert sorted(tuple(r) for r in first.collect()) == plain_collocations(rows, 8, most=5)
    assert collocations.mine(df.limit(0), least=8).count() == 0


def test_heavy_prefixes_are_extended(spark):
    rows = [("en", "a b c d e " * 60), ("en", "a c " * 50)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    words = collocations.count_words(docs).where("n >= 2").cache()
    frequent = collocations.bit_filter(words.select("h"), "h", 1 << 20)
    groups, extended = collocations.partition(docs, words.select("lang", "word", "h", "n"), frequent, 55)
    assert [len(h) for h in groups.heavy] == [5, 5, 5, 0]  # a .. e; their pairs but a c; and so on
    assert sorted(len(r["w"]) for r in extended.collect()) == [2] * 5 + [3] * 5
    assert collocations.partition(docs, words, frequent, 10_000)[0].heavy[0].tolist() == []


def test_stretches_meet(spark, monkeypatch):
    rng = random.Random(10)
    rows = texts(rng, 60)
    docs = spark.createDataFrame(rows, "lang string, text string")
    monkeypatch.setattr(collocations, "STRETCH", 17)
    assert sorted(tuple(r) for r in collocations.mine(docs, least=5).collect()) == plain_collocations(rows, 5)
