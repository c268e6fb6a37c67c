"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, byte_bpe, chat, exact_dedup, fingerprint, merkle, minhash, mixing, quality, secret_scan, token_store, toxicity, vector_search
from .common import prepare, table


def vocabulary(name: str) -> str:
    """Path of an installed public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def pre_token_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Syncmer fingerprints of all documents, their edited texts and their likeness."""
    prepare(spark)
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents by pattern and by the randomness battery."""
    prepare(spark)
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents over two-word shingles."""
    prepare(spark)
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents deduplicated against a fresh digest index."""
    prepare(spark)
    return exact_dedup.decisions(table(spark, sf_dir, "documents"), exact_dedup.DigestIndex(spark))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents from the additive model."""
    prepare(spark)
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of all documents' ids and decoded bytes."""
    prepare(spark)
    return byte_bpe.encode_digests(
        table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), pre_token_pattern()
    )


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids written in directly addressable codes and read back."""
    prepare(spark)
    path = token_store.fresh_path(spark)
    token_store.write_ids(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), path, end_id=1)
    return token_store.read_ids(spark, path)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents by their nearest labelled examples."""
    prepare(spark)
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def source_number() -> Column:
    """The number a source's name ends with, 0 without one."""
    digits = F.regexp_extract(F.coalesce(F.col("source"), F.lit("")), r"(\d+)$", 1)
    return F.when(digits == "", 0).otherwise(digits.cast("bigint"))


def domain_of_source() -> Column:
    """Four domains dealt out by the number of the source."""
    names = F.array(*[F.lit(x) for x in ("books", "code", "forum", "web")])
    return F.get(names, (source_number() % 4).cast("int"))


def mixture_weights() -> dict[str, Column]:
    """Target weights: by domain, by language, and 1 to 3 by source."""
    return {
        "domain": F.get(F.array(*[F.lit(x) for x in (2, 3, 1, 5)]), (source_number() % 4).cast("int")),
        "lang": F.when(F.col("lang") == "en", 6).when(F.col("lang").isin("de", "fr"), 2).otherwise(1),
        "source": 1 + source_number() % 3,
    }


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mixture of 60 % of the corpus's tokens, up to three epochs of a leaf."""
    prepare(spark)
    return mixing.mix(
        table(spark, sf_dir, "documents"), None, mixture_weights(), domain_of_source(), seed=17, max_epochs=3, share=0.6
    )


TOOLS = ("search", "fetch", "calculate", "translate", "erase")
#: (tool, parameter, type, required, allowed values); "erase" is declared nowhere.
TOOL_PARAMETERS = [
    ("search", "query", "string", True, None),
    ("search", "limit", "integer", True, None),
    ("search", "after", "array", False, None),
    ("fetch", "query", "string", True, None),
    ("fetch", "limit", "integer", True, [str(i) for i in range(30)]),
    ("fetch", "after", "array", False, None),
    ("calculate", "query", "string", True, None),
    ("calculate", "limit", "number", False, None),
    ("calculate", "after", "array", False, None),
    ("translate", "query", "string", True, None),
    ("translate", "limit", "string", False, None),
    ("translate", "after", "array", False, None),
]


def derived_calls(conversations: DataFrame) -> DataFrame:
    """A tool call for every assistant turn, faulty in ways that its position decides."""
    said = conversations.where(F.col("role") == "assistant")
    kind = (F.col("conv_id") + F.col("turn")) % 6
    name = F.get(F.array(*[F.lit(t) for t in TOOLS]), ((F.col("conv_id") * 7 + F.col("turn")) % 5).cast("int"))
    call = lambda turn: F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("_"), turn.cast("string"))
    limit = (F.length(F.coalesce("text", F.lit(""))) % 50).cast("string")
    before = F.when(kind == 4, call(F.col("turn") + 2)).when(F.col("turn") >= 3, call(F.col("turn") - 2))
    arguments = F.concat(
        F.lit('{ "query" : '), chat.quoted(F.coalesce("text", F.lit(""))),
        F.when(kind == 0, F.concat(F.lit(', "limit": "'), limit, F.lit('"')))
        .when(kind == 1, F.lit("")).otherwise(F.concat(F.lit(', "limit": '), limit)),
        F.when(kind == 2, F.lit(', "debug": [1, {"b": null, "a": true}]')).otherwise(F.lit("")),
        F.when(before.isNull(), F.lit("")).otherwise(F.concat(F.lit(', "after": ["'), before, F.lit('"]'))),
        F.when(kind == 3, F.lit("")).otherwise(F.lit(" }")),
    )
    return said.select("conv_id", "turn", call(F.col("turn")).alias("call_id"), name.alias("name"), arguments.alias("arguments"))


def derived_results(conversations: DataFrame) -> DataFrame:
    """Every later user turn answers the call of the turn before it."""
    said = conversations.where((F.col("role") == "user") & (F.col("turn") >= 1))
    call = F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("_"), (F.col("turn") - 1).cast("string"))
    return said.select("conv_id", "turn", call.alias("call_id"), F.col("text").alias("content"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations with their tool calls linked, ordered, validated and serialised."""
    prepare(spark)
    said = table(spark, sf_dir, "conversations")
    schemas = spark.createDataFrame(
        TOOL_PARAMETERS, "name string, param string, type string, required boolean, allowed array<string>"
    )
    return chat.format_chats(said, derived_calls(said), derived_results(said), schemas)


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle manifest of all documents, each with its proof and what the proof gives after tampering."""
    prepare(spark)
    return merkle.manifest(table(spark, sf_dir, "documents")).drop("lang", "segment")


def op12_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every 20th one, through balanced posting lists."""
    prepare(spark)
    return vector_search.nearest(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' tokens in two vocabularies, aligned by byte ends and counted over the corpus."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    return alignment.alignment_counts(docs, vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_fingerprint, op2_secret_scan, op3_minhash, op4_exact_dedup, op5_quality, op6_byte_bpe, op7_token_store,
        op8_toxicity, op9_mixing, op10_chat, op11_merkle, op12_vector_search, op13_alignment,
    )
}
