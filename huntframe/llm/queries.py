"""The training-data operators as registered queries over the whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from huntframe.llm import (
    bpe, conversations, decontaminate, language, neighbours, pitman_yor, secrets, similarity, suffixes, tokencounts,
    tokenfile, toxicity, whitening,
)
from huntframe.session import scratch_path

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_SQL: dict[str, str] = {}

_SMALL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# Every pair that shares a shingle is compared; a component is what links reach, step by step.
LLM_SQL["op4_jaccard_components"] = f"""WITH RECURSIVE w AS (
        SELECT doc_id, regexp_extract_all({_SMALL}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
    sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')) END) AS s FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
    common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
    linked AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
    reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN linked l ON l.a = r.b)
    SELECT d.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(r.b) AS component_id
    FROM documents d JOIN reach r ON r.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id"""

# Windows of every length that occurs are met with the documents' word runs of that length.
_WORDS = f"regexp_extract_all({_SMALL}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
LLM_SQL["op7_decontamination"] = f"""WITH items AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
    win AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, unnest(list_transform(range(1, len(ws) - least(len(ws), 10) + 2),
        lambda i: array_to_string(ws[i:i + least(len(ws), 10) - 1], ' '))) AS run FROM items WHERE len(ws) > 0),
    d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
    runs AS (SELECT doc_id, k.n, unnest(list_transform(range(1, len(ws) - k.n + 2), lambda i: {{'place': i, 'run': array_to_string(ws[i:i + k.n - 1], ' ')}})) AS r
        FROM d, (SELECT DISTINCT n FROM win) k WHERE len(ws) >= k.n),
    found AS (SELECT doc_id, runs.n, r.place AS place, item_id FROM runs JOIN win ON win.n = runs.n AND win.run = r.run),
    hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(place, place + n)) AS p FROM found) GROUP BY 1),
    named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (
        SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found WHERE item_id IS NOT NULL) GROUP BY 1)
    SELECT d.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
        sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)"""


def _query(build):
    LLM_QUERIES[build.__name__] = build
    return build


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@_query
def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and the text they decode to, as digests."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoded = bpe.encode(_table(spark, sf_dir, "documents"), path, keep=["doc_id"])
    decoded = bpe.decode(encoded, path, keep=["doc_id", "n_tokens", "ids"])
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                          F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


@_query
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that stand in a window of a benchmark item."""
    found = decontaminate.mark(_table(spark, sf_dir, "documents").select("doc_id", "text"),
                               _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


def _remainder(by: int):
    """crc32 of the doc_id as text, by which documents are held out."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(by))


@_query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How likely each document is toxic, learned from labels outside the held-out third."""
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    fitted = toxicity.fit(documents.filter(_remainder(3) != 1), _table(spark, sf_dir, "labels"))
    held_out = F.coalesce(_remainder(3) == 1, F.lit(False)).alias("held_out")
    scored = toxicity.score(documents.select("doc_id", "text", held_out), fitted)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@_query
def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each document, learned outside the held-out third."""
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(documents.filter(_remainder(3) != 1))
    held_out = F.coalesce(_remainder(3) == 1, F.lit(False)).alias("held_out")
    return language.predict(documents.select("doc_id", "text", held_out), model).drop("text")


@_query
def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as token files and read back from them."""
    path = scratch_path(spark, "tokens")
    tokenfile.write(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return tokenfile.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@_query
def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every twentieth vector."""
    return neighbours.search(_table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


@_query
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document under a unigram vocabulary."""
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokencounts.count_tokens(documents, public_tokenizers.path("piece_bpe_32k.model")).drop("text")


@_query
def op4_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents linked by nine tenths of their three-word shingles."""
    return similarity.link(_table(spark, sf_dir, "documents"), size=3, percent=90)


@_query
def op3_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document in 50-byte strings that a document with a smaller id has as well."""
    found = suffixes.repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
                        removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                        F.sha2("kept", 256).alias("kept_sha256"))


@_query
def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document under a model of six sevenths of them."""
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(_remainder(7) == 2, F.lit(False))
    scored = pitman_yor.score(documents.withColumn("held_out", held_out), ~held_out)
    return scored.drop("text")


@_query
def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: the spans of the patterns as a digest, and all spans."""
    found = secrets.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))

    def counted(kind: str):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("secrets", lambda s: s["kind"].isin("assign", "access", "hex"))
    return found.select("doc_id", counted("assign"), counted("access"), counted("hex"),
                        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
                        listed(F.col("secrets")).alias("spans"))


@_query
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest repair of every conversation, after some damage."""
    damaged = conversations.damage(_table(spark, sf_dir, "conversations"))
    found = conversations.repair(damaged, copies="copies", texts=False)
    return found.filter("last").select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
                                       "repaired_sha256")


@_query
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the eight leading principal directions of all, at unit variance."""
    return whitening.whiten(_table(spark, sf_dir, "embeddings"), components=8)
