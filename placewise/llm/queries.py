"""Registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placewise.llm import collocations, decontaminate, embeddings, jaccard, langid, negatives, pieces, pii, repeats, sharding, tokens, toxicity, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def on_workers(spark: SparkSession) -> None:
    """Let Python workers find this package where it runs in place, without an installation or --py-files."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        @wraps(fn)
        def run(spark: SparkSession, folder: str) -> DataFrame:
            on_workers(spark)
            return fn(spark, folder)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet").select(*columns)


@query("op1_token_sequences")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.token_table(table(spark, folder, "documents", "doc_id", "text"), vocabulary("byte_bpe_50k.json"), end=2, added=True)


@query("op2_sentencepiece")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    path = vocabulary("piece_bpe_32k.model")
    encoded = pieces.encode(table(spark, folder, "documents", "doc_id", "text").withColumn("given", F.crc32(F.coalesce("text", F.lit("")))), path)
    back = pieces.decode(encoded.drop("text"), path)
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.xxhash64("ids").alias("ids_hash"), F.crc32("text").alias("text_crc32"), (F.crc32("text") == F.col("given")).alias("round_trip"))


@query("op3_shards")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    out = sharding.shard(docs, 40)
    size = (F.octet_length(text) + 16).cast("long").alias("size")
    return out.select("doc_id", size, F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op4_embedding_dedup")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, folder, "embeddings", "vec_id", "embedding", "label"))


@query("op5_pii")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return pii.report(table(spark, folder, "documents", "doc_id", "text"))


@query("op6_ngram_jaccard")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.classes(table(spark, folder, "documents", "doc_id", "text"))


def _url_sql() -> str:
    """Host, path, rules and bounded terms in DuckDB's SQL."""
    rules = sorted(RULES, key=lambda r: (-len(r[1]), r[1]))
    cases = {}
    for out in (0, 1):
        whens = []
        for rule in rules:
            name, _, below = rule[1].partition("/")
            whens.append(f"WHEN (host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '/{below}') THEN '{rule[1 - out]}'")
        cases[out] = "CASE " + " ".join(whens) + " ELSE NULL END"

    def hits(terms):
        bounded = [f"CAST(regexp_matches(low, '(^|[^\\p{{L}}\\p{{N}}]){t}($|[^\\p{{L}}\\p{{N}}])') AS INTEGER)" for t in terms]
        return "(" + " + ".join(bounded) + ")"

    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
    WITH a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest, translate(coalesce(url, ''), '{upper}', '{lower}') AS low FROM pages),
    b AS (SELECT page_id, low, rest, regexp_extract(rest, '^[^/?#]*') AS h FROM a),
    c AS (SELECT page_id, low, translate(h, '{upper}', '{lower}') AS host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM b),
    d AS (SELECT *, {cases[0]} AS rule, {cases[1]} AS ruled, {hits(urls.STRICT)} AS strict_hits, {hits(urls.SOFT)} AS soft_hits FROM c)
    SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN strict_hits > 0 OR soft_hits >= {urls.SOFT_LIMIT} THEN 'block' ELSE 'allow' END) AS verdict,
           CAST(strict_hits AS INTEGER) AS strict_hits, CAST(soft_hits AS INTEGER) AS soft_hits FROM d"""


@query("op7_url_filter", _url_sql())
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge(table(spark, folder, "pages", "page_id", "url"), RULES).drop("url")


@query("op8_decontaminate")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.report(table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "benchmark", "item_id", "text"))


@query("op9_repeats")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    out = repeats.dedupe(table(spark, folder, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op10_toxicity")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text")
    model = toxicity.train(docs, table(spark, folder, "labels", "doc_id", "toxic"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op11_language_id")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text", "lang").withColumn("held_out", langid.held_out(F.col("doc_id")))
    taught = docs.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    return langid.predict(docs.drop("lang"), langid.train(taught, vocabulary("piece_bpe_32k.model"))).drop("text")


_NEGATIVES_SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS g, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS other, a.g = r.g AS same, CAST(list_sum(list_transform(list_zip(a.v, r.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM e a JOIN e r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id AND len(a.v) = len(r.v)),
p AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
n AS (
  SELECT p.anchor_id, positive_id, other AS negative_id, positive_score, score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 30 * CAST(positive_score AS HUGEINT) <= 100 * CAST(score AS HUGEINT) AND 100 * CAST(score AS HUGEINT) <= 90 * CAST(positive_score AS HUGEINT))
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10"""


@query("op12_hard_negatives", _NEGATIVES_SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings", "vec_id", "embedding", "label")
    shifted = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.mine(shifted, F.col("vec_id") % 100 == 0)


_COLLOCATIONS_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, row_number() OVER () AS p, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM d),
i AS (SELECT lang, p, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM w),
g AS (SELECT lang, w AS w1, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3, lead(w, 3) OVER o AS w4 FROM i WINDOW o AS (PARTITION BY p ORDER BY i)),
f AS MATERIALIZED (
  SELECT lang, 1 AS m, w1 AS phrase, count(*) AS f FROM g GROUP BY ALL
  UNION ALL SELECT lang, 2, w1 || ' ' || w2, count(*) FROM g WHERE w2 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3, count(*) FROM g WHERE w3 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4, count(*) FROM g WHERE w4 IS NOT NULL GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE m >= 2 AND f >= 30),
k AS (SELECT c.*, k, array_to_string(ws[1:k], ' ') AS head, array_to_string(ws[k + 1:m], ' ') AS tail FROM c, range(1, 4) t(k) WHERE k < m),
x AS MATERIALIZED (SELECT k.*, f.f AS l FROM k JOIN f ON k.lang = f.lang AND k.head = f.phrase),
s AS (SELECT x.lang, x.phrase, a, l, f.f AS r, CAST((2000000 * CAST(a AS HUGEINT)) // (CAST(l AS HUGEINT) + f.f) AS BIGINT) AS score
      FROM x JOIN f ON x.lang = f.lang AND x.tail = f.phrase
      QUALIFY row_number() OVER (PARTITION BY x.lang, x.phrase ORDER BY score, k) = 1),
u AS (SELECT lang, array_to_string(ws[i:i + x - 1], ' ') AS phrase, max(a) AS longer FROM c, range(1, 4) t(i), range(2, 4) y(x) WHERE x < m AND i + x - 1 <= m GROUP BY ALL),
o AS (SELECT s.* FROM s LEFT JOIN u ON s.lang = u.lang AND s.phrase = u.phrase WHERE longer IS NULL OR 100 * CAST(longer AS HUGEINT) < 80 * CAST(a AS HUGEINT)),
z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o)
SELECT z.lang, rank, phrase, a, l, r, n, score FROM z JOIN n ON z.lang = n.lang WHERE rank <= 2000"""


@query("op13_collocations", _COLLOCATIONS_SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.mine(table(spark, folder, "documents", "text", "lang"))
