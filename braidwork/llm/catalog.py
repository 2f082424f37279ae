"""The queries of this subpackage by name, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.llm import decontaminate, importance, language_id, license_scan, line_dedup, mixing, ngram_join, oracles, personal_data, prefix_trie, quality_rules, token_files, toxic_spans, url_filter
from braidwork.llm.scratch import delete_on_exit, scratch_path, written


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _remainder(n: int):
    """crc32 of doc_id as text, mod n."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text; null texts and those without a letter are ``und``. Ties go to the first language by name; repeated rows repeat."""
    docs = _documents(spark, sf_dir)
    model = language_id.train(docs.where(_remainder(4) != 2))
    held_out = F.coalesce(_remainder(4) == 2, F.lit(False)).alias("held_out")
    return language_id.predict(docs, model).select("doc_id", held_out, "lang_pred", "score", "rejected")


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ngram_join.near_duplicates`` of four-word shingles at 85 %; nulls, empties, ties and repeats as stated there."""
    return ngram_join.near_duplicates(_documents(spark, sf_dir), width=4, percent=85)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``license_scan.scan``; nulls, empties and repeats as stated there."""
    return license_scan.scan(_documents(spark, sf_dir))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``line_dedup.line_table``; nulls, empties, ties and repeats as stated there."""
    return line_dedup.line_table(_documents(spark, sf_dir)).drop("row_key")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``decontaminate.leaks``; nulls, empties, ties and repeats as stated there."""
    return decontaminate.leaks(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``url_filter.judge`` by the base rules; null and odd urls as stated there."""
    rules = spark.createDataFrame(url_filter.BASE_RULES, "verdict string, host string, path string")
    return url_filter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``mixing.mixed`` without the texts; nulls, empties and repeats as stated there."""
    return mixing.mixed(_documents(spark, sf_dir).select("doc_id", "text", "source"), without=("text",))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``personal_data.detect``; nulls, empties and repeats as stated there."""
    return personal_data.detect(_documents(spark, sf_dir))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of every text; null is empty and fails, a null source is no host, repeated rows repeat."""
    features = quality_rules.document_features(_documents(spark, sf_dir))
    slim = ["doc_id", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rules_failed"]
    return quality_rules.judged(written(features.select(*slim), name="features")).drop("source", "rules_failed")


def op10_toxic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``toxic_spans.score`` by a chain of the labelled rows that are not held out; nulls, empties and repeats as stated there. Documents without a label are scored alike."""
    docs = _documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").where(_remainder(5) != 0)
    chain = toxic_spans.train(labels, docs)
    held_out = F.coalesce(_remainder(5) == 0, F.lit(False)).alias("held_out")
    return toxic_spans.score(docs, chain).select("doc_id", held_out, "score", "predicted", "spans")


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What ``token_files.read_digests`` finds in the shards that ``token_files.write`` made; nulls, empties, ties and repeats as stated there."""
    import public_tokenizers

    path = scratch_path(spark, "shards")
    token_files.write(_documents(spark, sf_dir), path, tokenizer=public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    delete_on_exit(spark, path)
    return token_files.read_digests(spark, path)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``prefix_trie.trie`` of conversations spliced by fives; nulls, empties, ties and repeats as stated there."""
    turns = prefix_trie.turn_rows(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    rows, convs = prefix_trie.spliced(turns, group=5, most=9)
    return prefix_trie.trie(rows, convs).drop("first_node", "last_node")


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``importance.resampled`` of the documents towards the benchmark's texts, by single words; nulls, empties, ties and repeats as stated there."""
    return importance.resampled(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id, op2_ngram_jaccard, op3_license_scan, op4_line_dedup, op5_decontaminate, op6_url_filter, op7_mixing,
        op8_personal_data, op9_quality_rules, op10_toxic_spans, op11_token_files, op12_prefix_trie, op13_importance,
    )
}

ORACLES = {
    "op6_url_filter": r"""
        WITH parts AS (
          SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        split AS (
          SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
        rules(v, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
        best AS (
          SELECT page_id, host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v
          FROM split LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY ALL)
        SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM best""",
} | oracles.ORACLES
