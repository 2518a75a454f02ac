"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import align, ann, bpe, chat, langid, licenses, lmscore, mixing, runs, secrets, sharding, simhash, vecdedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Ranks and split pattern of the encoder.
RANK_PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Token shares of the mix.
TARGETS = {"high": 0.75, "low": 0.23, "toxic": 0.02}

SHARD_BYTES = 1 << 20


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLE[name] = oracle
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_secret_scan")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = docs.select("doc_id", secrets.secret_spans(F.col("text")).alias("found"))

    def of(*kinds: str):
        return F.filter("found", lambda f: f["kind"].isin(*kinds))

    base = ("assign", "access", "hex")
    more = [k for k in secrets.KINDS if k not in base]
    return found.select(
        "doc_id", *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in base],
        F.sha2(secrets.span_string(of(*base)), 256).alias("base_sha256"),
        secrets.span_string(F.col("found")).alias("spans"), *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in more])


@query("op2_language_id")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    profiles = langid.learn_profiles(docs.where(F.col("doc_id").isNotNull() & ~held_out))
    found = docs.select("doc_id", held_out.alias("held_out"), langid.detect_language(F.col("text"), profiles).alias("r"))
    return found.select("doc_id", "held_out", "r.lang_pred", "r.score", "r.runner_up", "r.n_letters")


@query("op3_license_scan", licenses.oracle())
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.license_scan(docs, licenses.known_licenses(spark)).withColumn("notices", F.array_join("notices", ","))


@query("op4_nearest_neighbours")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


@query("op5_embedding_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vecdedup.near_duplicate_vectors(table(spark, sf_dir, "embeddings"), threshold=0.93)


@query("op6_sharding", sharding.oracle(SHARD_BYTES))
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents").select("doc_id", "text"), SHARD_BYTES)


@query("op7_lm_score", lmscore.oracle())
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    good = mixing.label_domains(table(spark, sf_dir, "labels")).where("domain = 'high'").select("doc_id")
    scores = lmscore.cross_entropy_difference(docs, good)
    return scores.select("doc_id", "n_tokens", *[F.round(c, 6).alias(c) for c in ("loss_target", "loss_all", "score")])


@query("op8_byte_bpe")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = docs.select("doc_id", bpe.bpe_round_trip(spark, F.col("text"), RANK_PATH, public_tokenizers.PATTERN).alias("r"))
    return both.select("doc_id", (F.octet_length("r.ids") / 4).cast("long").alias("n_tokens"),
                       F.sha2("r.ids", 256).alias("ids_sha256"), F.sha2("r.decoded", 256).alias("decoded_sha256"))


@query("op9_simhash_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op10_source_mixing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = mixing.label_domains(table(spark, sf_dir, "labels"))
    mixed = mixing.mix(docs, labels, TARGETS)
    return mixed.select("doc_id", F.col("_mix.tokens").alias("n_tokens"),
                        *[F.col("_mix.posterior")[k].alias(f"p_{d}") for k, d in enumerate(sorted(TARGETS))],
                        F.col("_mix.rate").alias("rate"), F.col("_mix.copies").alias("copies"))


def with_rewritten_repetitions(docs: DataFrame) -> DataFrame:
    """Rewrites the texts of the documents chosen by their id: from word a on, the
    words are word a and the p - 1 words after it, over and over."""
    h = F.crc32(F.col("doc_id").cast("string"))
    chosen = F.coalesce(h % 10 == 0, F.lit(False))
    words = F.when(chosen, F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    split = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), words.alias("words"), F.coalesce(F.size(words), F.lit(0)).alias("n"))
    a = F.col("g") % F.col("n")
    p = 1 + F.floor((F.col("n") - a) / (3 + F.col("g") % 8))
    counted = split.select("doc_id", "text", "words", "n", F.when(F.col("n") > 0, a).alias("a"), F.when(F.col("n") > 0, p).alias("p"))
    new = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.col("words")[
        F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")])
    return counted.select("doc_id", F.when(F.col("n") > 0, F.array_join(new, " ")).otherwise(F.col("text")).alias("text"))


@query("op11_periodic_runs")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_rewritten_repetitions(table(spark, sf_dir, "documents"))
    found = docs.select("doc_id", runs.periodic_runs(spark, F.col("text")).alias("r"))
    # greatest length, then smallest start, then smallest period
    best = F.array_max(F.transform("r.runs", lambda x: F.struct(x["length"], -x["start"], -x["period"])))
    length, start, period = best["length"], -best["col2"], -best["col3"]
    line = F.transform("r.runs", lambda x: F.concat_ws(",", x["start"], x["length"], x["period"]))
    text = F.when(F.size("r.runs") > 0, F.concat(F.array_join(line, "\n"), F.lit("\n"))).otherwise("")
    return found.select(
        "doc_id", F.size("r.runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2(text, 256).alias("runs_sha256"), F.sha2("r.collapsed", 256).alias("collapsed_sha256"))


#: Tokenizers of the alignment.
A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@query("op12_tokenizer_alignment")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, postings = align.align_documents(spark, table(spark, sf_dir, "documents"), A_PATH, B_PATH)
    # only digests of the groups are shuffled
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    short = documents.select("block", "place", "doc_id", "n_a", "n_b", "n_groups", "n_links", digest.alias("groups_sha256"))
    return align.alignment_scores(spark, short, postings, align.piece_count(B_PATH))


#: A conversation whose texts hold control strings, added to the table.
MARKED_TURNS = r"""SELECT CAST(-7 AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, '\### Assistant: </turn> ok' AS text
FROM (VALUES (0, 'user'), (1, 'assistant')) AS t(turn, role)"""


@query("op13_chat_formatting", chat.oracle(MARKED_TURNS))
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = r"\### Assistant: </turn> ok"
    marked = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(marked)
    return chat.conversation_digests(chat.format_conversations(rows))
