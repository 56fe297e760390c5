"""The corpus operators as registered queries: each applies its operator to a whole table and derives the digest columns."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C
from . import byte_bpe, decontaminate, embeddings, importance, licenses, minhash, packing, search, secrets, sharding, substrings, token_counts, toxicity
from .oracles import oracle_sql as oracle_sql


def op1_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(C.read(spark, sf_dir, "documents"), shards=16)
    return out.select(
        F.col("key").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op2_wand_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.leaks(C.read(spark, sf_dir, "documents"), C.read(spark, sf_dir, "benchmark"))
    return out.withColumnsRenamed({"key": "doc_id", "item": "item_id"})


def op3_trigram_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(C.read(spark, sf_dir, "documents")).select(F.col("key").alias("doc_id"), "spans")
    base = [r.kind for r in secrets.RULES[:3]]
    as_text = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    counts = [F.expr(f"cast(size(filter(spans, x -> x.kind = '{k}')) as long)").alias(f"n_{k}") for k in base]
    own = F.filter("spans", lambda x: x["ord"] < len(base))
    return found.select("doc_id", *counts, F.sha2(as_text(own), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"))


def op4_quantised_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = embeddings.near_duplicates(C.read(spark, sf_dir, "embeddings"))
    return out.select(F.col("key").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


def op5_bayesian_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = minhash.near_duplicates(C.read(spark, sf_dir, "documents"), s=minhash.Settings(shingle=2))
    return out.select(F.col("key").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), "kept")


def op6_diagonal_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan(C.read(spark, sf_dir, "documents"))
    return out.select(
        F.col("key").alias("doc_id"), "n_words", F.col("n_exact").alias("n_base"), "first_word", "last_word", F.col("exact_labels").alias("base_labels"), "labels", "score"
    )


def op7_token_rollup(spark: SparkSession, sf_dir: str, batches: int = 4) -> DataFrame:
    """Documents are loaded in batches with a rough count (a quarter of their bytes), then revised to the tokenizer's; a
    batch is committed twice, and one is loaded again under another name and deleted. The totals are the tokenizer's over
    all documents, those without text included."""
    import public_tokenizers as P

    version = "byte_bpe_50k"
    docs = C.read(spark, sf_dir, "documents")
    exact = token_counts.counts(docs, token_counts.byte_bpe(P.path("byte_bpe_50k.tiktoken"), P.PATTERN), version)
    size = docs.select(
        F.col("doc_id").alias("key"), "source", F.col("lang").alias("language"), F.lit(version).alias("version"), F.expr("cast(coalesce(octet_length(text), 0) div 4 as long)").alias("tokens")
    )
    rough, exact = C.materialise(size, "rough-counts"), C.materialise(exact, "exact-counts")
    store = token_counts.Rollup(spark, f"{C.scratch_dir(spark)}/rollup-{uuid.uuid4().hex}")
    part = F.coalesce(F.pmod(F.xxhash64("key"), F.lit(batches)), F.lit(0))
    for i in range(batches):
        store.commit(f"load-{i}", token_counts.signed(rough.where(part == i), 1))
    store.compact()
    store.commit("revise", token_counts.revised(rough, exact))
    store.commit("load-0", token_counts.signed(rough.where(part == 0), 1))
    store.commit("again", token_counts.signed(exact.where(part == 1), 1))
    store.commit("delete", token_counts.signed(exact.where(part == 1), -1))
    return store.totals().select("source", F.col("language").alias("lang"), F.col("version").alias("tokenizer_version"), "docs", "tokens")


def held_out(key: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def op8_convolutional_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = C.read(spark, sf_dir, "documents"), C.read(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(~held_out()))
    out = toxicity.score(docs, model)
    return out.select(F.col("key").alias("doc_id"), held_out("key").alias("held_out"), "score", F.col("toxic").cast("int").alias("predicted"))


def op9_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.repeats(C.read(spark, sf_dir, "documents"))
    return out.select(
        F.col("key").alias("doc_id"), F.col("begin").alias("first_word"), F.col("end").alias("end_word"), F.col("first").alias("first_doc_id"), "similarity", "kept"
    )


def op10_histogram_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    pieces = packing.cut(C.read(spark, sf_dir, "documents"), tokenizer)
    pieces = pieces.select(F.col("key").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return packing.pack(C.materialise(pieces, "pieces"), key=("doc_id", "start"))


def op11_two_tier_bpe(spark: SparkSession, sf_dir: str, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    if ranks is None or pattern is None:
        import public_tokenizers

        ranks, pattern = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    out = byte_bpe.encode(C.read(spark, sf_dir, "documents"), ranks, pattern, decoded=True)
    decimal = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select(
        F.col("key").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), F.sha2(decimal, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op12_block_max_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = search.build(C.read(spark, sf_dir, "documents"))
    out = search.search(index, C.read(spark, sf_dir, "benchmark"), k=20)
    return out.select(F.col("item").alias("item_id"), "rank", F.col("key").alias("doc_id"), "score")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = importance.resample(C.read(spark, sf_dir, "documents"), C.read(spark, sf_dir, "benchmark"), importance.Settings(shortest=1, longest=1))
    return out.withColumnRenamed("key", "doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}
