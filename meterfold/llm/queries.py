"""The registered queries of these operators, and their SQL where SQL can express them."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterfold.llm import bpe_codec, decontamination, embedding_dedup, fill_in_middle, jaccard_join, language_id, line_dedup, lm_score, packing, prefix_trie, secret_scan, token_counts, url_filter
from meterfold.llm.common import remainder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
VOCABULARY = "byte_bpe_50k.json"


def query(name: str, sql: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return put


@query("op1_lm_score")
def op1(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("learn", remainder("doc_id", 5) != 1)
    scored = lm_score.score(docs)
    return scored.withColumn("held_out", ~F.col("learn")).drop("learn")


@query("op2_url_filter")
def op2(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages"))


@query("op3_jaccard_join")
def op3(spark, sf_dir):
    return jaccard_join.classes(table(spark, sf_dir, "documents"))


@query("op4_line_dedup", line_dedup.SQL)
def op4(spark, sf_dir):
    return line_dedup.summary(table(spark, sf_dir, "documents"))


@query("op5_packing")
def op5(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


@query("op6_decontamination")
def op6(spark, sf_dir):
    found = decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("row_hash").distinct()


@query("op7_embedding_dedup")
def op7(spark, sf_dir):
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op8_secret_scan")
def op8(spark, sf_dir):
    return secret_scan.summary(secret_scan.scan(table(spark, sf_dir, "documents")))


@query("op9_token_counts")
def op9(spark, sf_dir):
    counted = token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), budgets=(512,))
    return token_counts.over_limit(counted, 512)


@query("op10_language_id")
def op10(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.filter(remainder("doc_id", 3) != 1))
    held_out = docs.select(F.col("doc_id").cast("long"), "text", (remainder("doc_id", 3) == 1).alias("held_out"))
    return language_id.predict(held_out, model).withColumn("held_out", remainder("doc_id", 3) == 1).select("doc_id", "held_out", "lang_pred", "score")


@query("op11_bpe_codec")
def op11(spark, sf_dir):
    path = public_tokenizers.path(VOCABULARY)
    both = bpe_codec.decode(bpe_codec.encode(table(spark, sf_dir, "documents"), path), path)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


@query("op12_prefix_trie", prefix_trie.SQL)
def op12(spark, sf_dir):
    return prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.sequences(table(spark, sf_dir, "conversations")), every=5, most=8))


@query("op13_fill_in_middle", fill_in_middle.SQL)
def op13(spark, sf_dir):
    cut = fill_in_middle.transform(table(spark, sf_dir, "documents"), seed=1, rate=90, spm=20)
    again = fill_in_middle.restored(F.col("output"), F.col("form"))
    return cut.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(again, 256).alias("restored_sha256"),
    )
