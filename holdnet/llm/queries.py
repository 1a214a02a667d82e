"""The registered queries of the llm operators and their oracle SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from holdnet.llm import (centroids, chat, decontamination, lm, packing, piece_codec, quality_rules, secrets, simhash,
                         token_counts, token_files, toxicity, whitening)
from holdnet.llm.common import table
from holdnet.llm.oracles import LEAKS_SQL, QUALITY_SQL

QUERIES = {}
ORACLE = {}


def query(key: str, sql: str | None = None):
    def deco(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn
    return deco


@query("op10_quality_rules", QUALITY_SQL)
def op10(spark, sf_dir):
    return quality_rules.quality_report(table(spark, sf_dir, "documents"))


@query("op9_simhash")
def op9(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op8_decontamination", LEAKS_SQL)
def op8(spark, sf_dir):
    found = decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


@query("op4_secret_scans")
def op4(spark, sf_dir):
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    return found.select("doc_id", *[secrets.count_kind(k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
                        F.sha2(secrets.joined(base), 256).alias("base_sha256"),
                        secrets.joined(F.col("spans")).alias("spans"))


@query("op2_packing")
def op2(spark, sf_dir):
    return packing.pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op1_token_counts")
def op1(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op7_chat_formatting")
def op7(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", control), (-7, 1, "assistant", control)], turns.schema)
    return chat.digests(chat.read_back(chat.windows(turns.unionByName(extra))))


@query("op5_toxicity")
def op5(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@query("op3_lm_scoring")
def op3(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    scored = lm.score(docs, lm.train(docs.filter(~lm.held_out(F.col("doc_id"))), order=lm.ORDER))
    return scored.withColumn("held_out", lm.held_out(F.col("doc_id")))


@query("op6_token_binary")
def op6(spark, sf_dir):
    return token_files.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op12_sentencepiece")
def op12(spark, sf_dir):
    model = public_tokenizers.path("piece_bpe_32k.model")
    both = piece_codec.decode(piece_codec.encode(table(spark, sf_dir, "documents"), model), model, keep_ids=True)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), piece_codec.ids_digest().alias("ids_sha256"),
                       F.sha2(F.col("text"), 256).alias("decoded_sha256"))


@query("op13_centroids")
def op13(spark, sf_dir):
    return centroids.report(centroids.cluster(centroids.integer_vectors(table(spark, sf_dir, "embeddings"))))


@query("op11_whitening")
def op11(spark, sf_dir):
    return whitening.report(table(spark, sf_dir, "embeddings"))
