"""A training corpus from documents: toxic ones go, then copies and near copies, sources are mixed, and what stays is encoded."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramo.llm import bpe, exact_dedup, mixing, ngram_join, toxicity
from tramo.llm.queries import MIX, multilingual_bpe, table, with_domain
from tramo.llm.staging import drop_staged, quoted, stage, unused

#: Near copies: five-word shingles, a similarity of 0.8 or more.
NEAR = ngram_join.Join(k=5, percent=80)
#: Copies have just been removed, so no document is taken twice.
ONE_EPOCH = replace(MIX, max_epochs=1)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under 0.5."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal but for the case of A-Z, the one with the largest id."""
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents joined by links of near copies, the one with the smallest id."""
    return ngram_join.keep_one(docs, NEAR)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mixture takes; of each leaf's last one only the words that its budget has room for."""
    # names that the documents don't have
    domain, tokens, epoch, taken_col = (unused(docs, c) for c in ("domain", "n_tokens", "epoch", "taken"))
    mix = replace(ONE_EPOCH, levels=(domain, "lang", "source"), tokens=tokens, epoch=epoch, taken=taken_col)
    taken = mixing.select(with_domain(docs, domain).withColumn(tokens, mixing.n_words(F.col("text"))), mix)
    cut = F.col(taken_col) < F.col(tokens)
    text = mixing.prefix(F.col("text"), F.col(taken_col), F.col(tokens))
    return taken.withColumns({"text": text, "n_chars": F.when(cut, F.char_length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))}).select(*[quoted(c) for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, token_ids and n_tokens."""
    out = bpe.encode(docs.select("doc_id", "lang", "source", "text"), multilingual_bpe())
    return stage(out.withColumn("n_tokens", F.size("token_ids").cast("long")), "tokens")


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("n-gram join", drop_near_copies), ("mixing", mix_sources), ("byte-level BPE", encode)]

#: The last stage writes its result itself, so that the texts go through Python in small batches.
WRITTEN = ("byte-level BPE",)

#: The first stage learns a model, which SQL doesn't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, step in STAGES:
        docs = step(spark, docs, sf_dir)
        if name not in WRITTEN:
            docs = stage(docs, name.replace(" ", "-"))
        if before is not None:
            drop_staged(before)
        before = docs
    return docs
