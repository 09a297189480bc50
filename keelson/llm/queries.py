"""The queries of this subpackage: each operator, with production parameters, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, langid, licenses, media, mixing, pii, sharding, simhash, toxicity, vecdup
from .common import checkpoint, documents


def tokenizer_path() -> str:
    """Where the public tokenizer files are; only the driver reads them."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every text as the tokenizers library gives them, and what they decode to, as digests."""
    done = bpe.encode_decode(documents(spark, sf_dir).select("doc_id", "text"), tokenizer_path())
    return done.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and labels of every text."""
    return licenses.report(licenses.scan(documents(spark, sf_dir).select("doc_id", "text")), "doc_id")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document."""
    return sharding.shard(documents(spark, sf_dir).select("doc_id", "text")).drop("position")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(documents(spark, sf_dir).select("doc_id", "text"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text: base spans by kind, and all spans."""
    found = checkpoint(pii.candidates(documents(spark, sf_dir).select("doc_id", "text")).drop("text"))
    model = pii.fit(found)
    base = F.filter("candidates", lambda x: x["base"])
    count = lambda kind: F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    spans = pii.digest(pii.accepted(model, F.col("candidates"))).alias("spans")
    return found.select("doc_id", *[count(k) for k in pii.KINDS[:4]], F.sha2(pii.digest(base), 256).alias("base_sha256"), spans)


def op8_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector."""
    return vecdup.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text."""
    docs = documents(spark, sf_dir)
    model = langid.fit(docs.filter(~langid.held_out()))
    return langid.identify(docs.select("doc_id", langid.held_out().alias("held_out"), "text"), model)


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a motion-JPEG clip, stored and read back, as digests."""
    return media.round_trip(documents(spark, sf_dir).select("doc_id", "text"), digests=True)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text."""
    docs = documents(spark, sf_dir)
    model = toxicity.fit(docs, toxicity.learnable(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    scored = toxicity.score(docs.select("doc_id", toxicity.held_out("doc_id", 3, 1).alias("held_out"), "text"), model)
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_licenses": op2_licenses,
    "op3_mixing": op3_mixing,
    "op4_media": op4_media,
    "op5_sharding": op5_sharding,
    "op6_pii": op6_pii,
    "op7_simhash": op7_simhash,
    "op8_vectors": op8_vectors,
    "op9_toxicity": op9_toxicity,
    "op10_langid": op10_langid,
}
ORACLES: dict[str, str] = {}
