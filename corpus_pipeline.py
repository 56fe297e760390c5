"""Corpus cleaning in five stages; each is written as Parquet and reread as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.ship import ship
from ledgerline.llm import _common as C
from ledgerline.llm import decontaminate, minhash, packing, secrets, toxicity
from ledgerline.llm.queries import held_out


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go. It learns from labelled documents outside the held-out fifth. Null and
    empty texts are judged as empty; each row is judged by itself. Empty table: no rows, as in all stages."""
    model = toxicity.fit(docs, C.read(spark, sf_dir, "labels").where(~held_out()))
    return toxicity.without_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays; documents without words or without a
    doc_id all stay. Rows of one doc_id stay or go together. Near: five-word shingles, a similarity of 0.8 or more."""
    ship(spark)
    out = minhash.near_duplicates(docs)
    gone = out.where("key is not null and not kept").select(F.col("key").alias("_key")).distinct()
    return docs.join(gone.hint("shuffle_hash"), docs["doc_id"] == gone["_key"], "left_anti")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item's question and answer go. Null and empty texts stay; each row is judged by itself."""
    return decontaminate.without_leaks(docs, C.read(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in its text are replaced, and n_chars counts the new text. Null text becomes empty."""
    ship(spark)
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    found = secrets.scan(docs, keep=others)
    text = secrets.redacted()
    new = {"doc_id": F.col("key"), "text": text, "n_chars": F.length(text).cast("long")}
    return found.select(*(new.get(c, F.col(f"kept.`{c}`")).alias(c) for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document, with its sequence and offset. Null and empty texts have the end token only;
    repeated rows are packed each."""
    import public_tokenizers

    ship(spark)
    pieces = packing.cut(docs, public_tokenizers.path("word_bpe_49k.json"))
    pieces = pieces.select(F.col("key").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return packing.pack(C.materialise(pieces, "pieces"), key=("doc_id", "start"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("packing", pack),
]

#: The classifier and the tokenizer can't be expressed in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = C.materialise(docs, name)
    return docs
