"""The operators as named queries on the test tables, and their SQL."""

from pyspark.sql import DataFrame, SparkSession

from txscreen.llm import (
    ann,
    bpe,
    decontam,
    jaccard,
    langid,
    linedup,
    manifest,
    mixing,
    oracle,
    quality,
    reputation,
    retrieval,
    sharding,
    substrings,
)
from txscreen.llm.common import read


def word_bpe_path() -> str:
    """The vocabulary of the contract, from the public tokenizers' package."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.join_documents(read(spark, folder, "documents"))


def op2_bpe(spark: SparkSession, folder: str) -> DataFrame:
    definition = bpe.load_definition(word_bpe_path())
    return bpe.encode_documents(read(spark, folder, "documents"), definition)


def op3_substrings(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.remove_repeats(read(spark, folder, "documents"))


def op4_lines(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    return linedup.digest(linedup.drop_frequent_lines(docs))


def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge(read(spark, folder, "documents"))


def op6_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(read(spark, folder, "documents"), by_size=True)


def op7_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return ann.nearest(read(spark, folder, "embeddings"))


def op8_urls(spark: SparkSession, folder: str) -> DataFrame:
    return reputation.filter_urls(read(spark, folder, "pages"))


def op9_shards(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.interleaved(read(spark, folder, "documents"))


def op10_language(spark: SparkSession, folder: str) -> DataFrame:
    return langid.identify(read(spark, folder, "documents"))


def op11_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontam.find_contamination(
        read(spark, folder, "documents"), read(spark, folder, "benchmark")
    )
    return decontam.digest(found)


def op12_search(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.search(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


def op13_manifest(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    return manifest.verified(manifest.proofs(docs, altered=manifest.sampled_change()))


QUERIES = {
    q.__name__: q
    for q in (
        op1_jaccard,
        op2_bpe,
        op3_substrings,
        op4_lines,
        op5_quality,
        op6_mix,
        op7_neighbours,
        op8_urls,
        op9_shards,
        op10_language,
        op11_decontamination,
        op12_search,
        op13_manifest,
    )
}

ORACLE_SQL = {
    "op1_jaccard": oracle.JACCARD,
    "op3_substrings": oracle.SUBSTRINGS,
    "op4_lines": linedup.SQL,
    "op5_quality": oracle.QUALITY,
    "op6_mix": mixing.SQL,
    "op8_urls": reputation.SQL,
    "op9_shards": oracle.SHARDS,
    "op11_decontamination": decontam.SQL,
    "op12_search": retrieval.SQL,
    "op13_manifest": oracle.MANIFEST,
}
