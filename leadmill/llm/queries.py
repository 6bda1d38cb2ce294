"""The registered queries of this subpackage: thin bindings of the operators to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leadmill.llm._shared import crc_mod
    from leadmill.llm.language_id import identify, train

    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False))
    found = identify(docs, train(docs.where(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leadmill.llm.decontamination import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leadmill.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), ranks_path=tokenizer("byte_bpe_50k.tiktoken"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leadmill.llm.sharding import shard_documents

    rows = shard_documents(table(spark, sf_dir, "documents"), 24)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leadmill.llm._shared import crc_mod
    from leadmill.llm.toxicity import score, train

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False))
    scored = score(docs, train(docs, labels.where(~held_out)))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leadmill.llm.jaccard_join import similar_components

    return similar_components(table(spark, sf_dir, "documents"), size=4, percent=85)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leadmill.llm.quality import BIT, apply_policy, ledger

    rows = apply_policy(ledger(table(spark, sf_dir, "documents")), "v1")
    base = F.col("failed").bitwiseAND(F.lit(BIT["few_words"] | BIT["repeated_windows"])) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "failed")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leadmill.llm.html_extraction import extract_text, train

    return extract_text(table(spark, sf_dir, "pages"), train())


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leadmill.llm.secret_scan import KINDS, scan, train, written

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    found = scan(docs, train(docs))
    # a second argument of filter's function would be the place in the array
    count = lambda i: F.size(F.filter("base_spans", lambda s: s["kind"] == i)).cast("long")
    counts = [count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(written(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leadmill.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leadmill.llm.whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leadmill.llm.spelling import variant_groups

    return variant_groups(table(spark, sf_dir, "documents"))


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leadmill.llm.neighbours import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


WORDS = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that it can express on whole tables; the tests hold the others against brute force."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    joined = f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, {WORDS.format(lower)} AS ws FROM documents),
 s AS (SELECT DISTINCT rid, array_to_string(ws[i:i + 3], ' ') AS g FROM (SELECT rid, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM d WHERE len(ws) > 0)),
 n AS (SELECT rid, count(*) AS n FROM s GROUP BY 1),
 p AS (SELECT x.rid AS a, y.rid AS b, count(*) AS shared FROM s x JOIN s y ON x.g = y.g AND x.rid <> y.rid GROUP BY 1, 2),
 e AS (SELECT a, b FROM p JOIN n x ON x.rid = a JOIN n y ON y.rid = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
 r AS (SELECT rid AS a, rid AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(o.doc_id) AS component_id FROM d LEFT JOIN n USING (rid) JOIN r ON r.a = d.rid JOIN d o ON o.rid = r.b GROUP BY d.rid, d.doc_id"""
    rules = rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
 w AS (SELECT *, {WORDS.format("t")} AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
 g AS (SELECT rid, i, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
 c AS (SELECT rid, count(DISTINCT i + k) AS n FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS times FROM g) CROSS JOIN range(5) r(k) WHERE times > 1 GROUP BY 1),
 m AS (SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
  length(t) - length(replace(t, '!', '')) AS n_exclamations FROM w LEFT JOIN c USING (rid)),
 f AS (SELECT *, n_words < 10 AS few, 100 * n_repeat_words > 20 * n_words AS repeated, 10 * n_symbols > 5 * n_words AS symbols, 100 * n_dup_lines > 30 * n_lines AS dup, word_chars < 2 * n_words AS short, word_chars > 20 * n_words AS long, 10 * n_exclamations > 5 * n_words AS shout FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, few OR repeated AS base_failed, NOT (few OR repeated OR symbols OR dup OR short OR long OR shout) AS kept,
 CAST(few::INT + 2 * repeated::INT + 4 * symbols::INT + 8 * dup::INT + 16 * short::INT + 32 * long::INT + 64 * shout::INT AS BIGINT) AS failed FROM f"""
    return {"op6_ngram_jaccard_join": joined, "op7_quality_rules": rules}
