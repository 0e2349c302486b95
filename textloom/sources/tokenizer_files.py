"""Reading and writing tokenizer artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators.bpe import MERGES_SCHEMA, VOCAB_SCHEMA, Tokenizer

ARTIFACT_SCHEMA = (
    "added_tokens array<struct<id: int, content: string, special: boolean>>,"
    " normalizer struct<type: string>, pre_tokenizer struct<type: string>,"
    " model struct<type: string, unk_token: string, vocab: map<string,int>, merges: array<array<string>>>"
)
# Names of the pre-tokenizers in artifacts.
SCHEMES = {"Whitespace": "word", "ByteLevel": "byte"}


def read_artifact(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ARTIFACT_SCHEMA).json(path, multiLine=True)


def artifact_vocab(artifact: DataFrame) -> DataFrame:
    return artifact.select(F.explode("model.vocab").alias("token", "id"))


def artifact_merges(artifact: DataFrame) -> DataFrame:
    return artifact.select(F.posexplode("model.merges").alias("rank", "pair")).select(
        "rank", F.col("pair")[0].alias("left"), F.col("pair")[1].alias("right")
    )


def tokenizer_from_tables(vocab: DataFrame, merges: DataFrame, scheme: str, specials=None) -> Tokenizer:
    """Both tables are bounded by the vocabulary size and become driver values."""
    tokens = [r.token for r in vocab.orderBy("id").collect()]
    pairs = [(r.left, r.right) for r in merges.orderBy("rank").collect()]
    extra = {} if specials is None else {"specials": tuple(specials)}
    return Tokenizer(tuple(tokens), tuple(pairs), scheme, **extra)


def load_artifact(spark: SparkSession, path: str) -> Tokenizer:
    artifact = read_artifact(spark, path)
    head = artifact.select("pre_tokenizer.type", "added_tokens").first()
    specials = [t.content for t in sorted(head.added_tokens, key=lambda t: t.id) if t.special]
    return tokenizer_from_tables(
        artifact_vocab(artifact), artifact_merges(artifact), SCHEMES[head.type], specials
    )


def save_tokenizer(spark: SparkSession, tokenizer: Tokenizer, path: str) -> None:
    """``vocab`` and ``merges`` as parquet tables under ``path``."""
    tokenizer.vocab_table(spark).write.parquet(f"{path}/vocab")
    tokenizer.merges_table(spark).write.parquet(f"{path}/merges")


def load_tokenizer(spark: SparkSession, path: str, scheme: str = "byte") -> Tokenizer:
    return tokenizer_from_tables(
        spark.read.schema(VOCAB_SCHEMA).parquet(f"{path}/vocab"),
        spark.read.schema(MERGES_SCHEMA).parquet(f"{path}/merges"),
        scheme,
    )
