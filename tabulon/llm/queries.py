"""Registered queries of the corpus operators, with production parameters on whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm import decontam, imatch, licenses, packing, periodic, repeats, resampling, secrets, sharding, simhash, token_counts, toxicity, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TOKENIZER = "word_bpe_49k.json"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def query(f: Callable[[SparkSession, str], DataFrame]):
    QUERIES[f.__name__] = f
    return f


@query
def op1_toxicity(spark, folder):
    docs = table(spark, folder, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, folder, "labels")))


@query
def op2_simhash(spark, folder):
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op3_repeats(spark, folder):
    return repeats.remove_repeats(table(spark, folder, "documents"))


@query
def op4_packing(spark, folder):
    return packing.pack(table(spark, folder, "documents"), public_tokenizers.path(TOKENIZER))


@query
def op5_token_counts(spark, folder):
    return token_counts.token_report(table(spark, folder, "documents"), public_tokenizers.path(TOKENIZER))


@query
def op6_sharding(spark, folder):
    return sharding.shard(table(spark, folder, "documents"))


@query
def op7_secrets(spark, folder):
    docs = table(spark, folder, "documents")
    return secrets.scan(docs, secrets.fit(docs))


@query
def op8_imatch(spark, folder):
    return imatch.compare_edits(table(spark, folder, "documents"))


@query
def op9_licenses(spark, folder):
    return licenses.scan(table(spark, folder, "documents"))


@query
def op10_decontamination(spark, folder):
    return decontam.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


RULES = (urls.Rule("allow", "com/"), urls.Rule("block", "example.com/en/"), urls.Rule("allow", "www.example.com/en/"),
         urls.Rule("block", "net/es/"), urls.Rule("block", "net/fr/"))


@query
def op11_urls(spark, folder):
    return urls.judged(table(spark, folder, "pages"), RULES, urls.fit(urls.labelled_urls(spark)))


# Checksums of words are computed bit by bit, once per distinct word.
ORACLES["op12_resampling"] = r"""
WITH tab AS (SELECT list(c ORDER BY n) AS t FROM (SELECT n, list_reduce(list_prepend(n, range(8)),
    lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(n))),
words AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM documents),
aims AS (SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
vocabulary AS (SELECT DISTINCT word FROM (SELECT word FROM words UNION ALL SELECT word FROM aims)),
spelled AS (SELECT word, list_transform(range(0, octet_length(encode(word))), lambda i: ('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::BIGINT) AS bytes FROM vocabulary),
buckets AS MATERIALIZED (SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket
    FROM spelled, tab),
s AS (SELECT bucket, count(*) AS n FROM words JOIN buckets USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM aims JOIN buckets USING (word) GROUP BY bucket),
totals AS (SELECT (SELECT count(*) FROM words) AS s_all, (SELECT count(*) FROM aims) AS t_all),
gains AS (SELECT b.bucket, floor(1000 * ln(((coalesce(t.n, 0) + 1) * (s_all + 10000))::DOUBLE / ((coalesce(s.n, 0) + 1) * (t_all + 10000))::DOUBLE))::BIGINT AS gain
    FROM (SELECT DISTINCT bucket FROM buckets) b LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket), totals),
weights AS (SELECT doc_id, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM words JOIN buckets USING (word) JOIN gains USING (bucket) GROUP BY doc_id),
scored AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln(
    (('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM documents LEFT JOIN weights USING (doc_id)),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= (SELECT count(*) FROM ranked) * 10 // 100 THEN r END AS rank FROM scored LEFT JOIN ranked USING (doc_id)
"""


@query
def op12_resampling(spark, folder):
    return resampling.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def with_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text) in which a tenth of the documents, by a checksum of the id, repeat one stretch of words to their end."""
    words = F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), "")
    h = F.crc32(F.col("doc_id").cast("string"))
    split = docs.select("doc_id", "text", h.alias("h")).withColumn("words", F.when(F.col("h") % 10 == 0, words))
    at = split.withColumn("g", F.floor(F.col("h") / 10)).withColumn("n", F.size("words").cast("long"))
    at = at.withColumn("a", F.expr("if(n > 0, g % greatest(n, 1), 0)"))
    at = at.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    period = F.expr("slice(words, cast(a + 1 as int), cast(p as int))")
    times = F.expr("cast(2 + (n - a) div p as int)")
    tail = F.slice(F.flatten(F.array_repeat(period, times)), F.lit(1), F.expr("cast(n - a as int)"))
    changed = F.array_join(F.concat(F.expr("slice(words, 1, cast(a as int))"), tail), " ")
    return at.select("doc_id", F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), changed).otherwise(F.col("text")).alias("text"))


@query
def op13_periodic(spark, folder):
    found = periodic.runs(with_periods(table(spark, folder, "documents")))
    best = F.expr("""aggregate(runs, cast(null as struct<start:bigint,length:bigint,period:bigint>),
        (best, r) -> if(best is null or r.length * best.period > best.length * r.period, r, best))""")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def oracles() -> dict[str, str]:
    """SQL with the same rows, for the queries that SQL can express on whole tables."""
    return dict(ORACLES)
