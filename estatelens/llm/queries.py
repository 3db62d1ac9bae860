"""The operators over the given tables, with production settings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estatelens.llm import checks
from estatelens.llm.ann_forest import nearest
from estatelens.llm.conversations import audit_conversations, damage
from estatelens.llm.decontaminate import find_contamination
from estatelens.llm.hard_negatives import mine_hard_negatives
from estatelens.llm.html_extract import extract
from estatelens.llm.line_dedup import line_report
from estatelens.llm.minhash import Near, near_duplicates
from estatelens.llm.packing import pack_documents
from estatelens.llm.quality import quality
from estatelens.llm.secrets import find_secrets
from estatelens.llm.token_count import count_tokens
from estatelens.llm.token_files import read_token_files, shared_folder, write_token_files
from estatelens.llm.trie_bpe import encode_documents
from estatelens.llm.workers import small_batches
from estatelens.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = checks.CHECKS


def vocabulary(name: str) -> str:
    """The file of a public tokenizer."""
    import public_tokenizers

    return public_tokenizers.path(name)


def register(build: Callable[[SparkSession, str], DataFrame]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(small_batches(configure(spark)), sf_dir)

    run.__name__, run.__doc__ = build.__name__, build.__doc__
    QUERIES[build.__name__] = run
    return build


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register
def op1_minhash_dedup(spark, sf_dir):
    """Near-duplicate groups by 3-word shingles at a Jaccard similarity of 0.85."""
    return near_duplicates(table(spark, sf_dir, "documents"), Near(words=3, percent=85))


@register
def op2_token_counts(spark, sf_dir):
    """Tokens of each document, huge ones by overlapping chunks."""
    return count_tokens(
        table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), limit=2048
    )


@register
def op3_secret_scan(spark, sf_dir):
    """Secrets of each document, with live and copied values told apart by who owns them."""
    return find_secrets(table(spark, sf_dir, "documents"))


@register
def op4_trie_bpe(spark, sf_dir):
    """Ids of each document by the trie of its words, and the text decoded from them."""
    return encode_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


@register
def op5_line_dedup(spark, sf_dir):
    """Documents without lines that are similar to an earlier line of the corpus."""
    return line_report(table(spark, sf_dir, "documents"))


@register
def op6_ann_forest(spark, sf_dir):
    """The 20 nearest vectors of every twentieth vector."""
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20)


@register
def op7_html_extract(spark, sf_dir):
    """Main text of each web page."""
    return extract(table(spark, sf_dir, "pages"))


@register
def op8_best_fit_packing(spark, sf_dir):
    """Documents packed into sequences of 1024 tokens."""
    return pack_documents(
        table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), capacity=1024, end_id=2
    )


@register
def op9_quality_rules(spark, sf_dir):
    """Counts of each document and the verdict of the line-frequency rule."""
    return quality(table(spark, sf_dir, "documents"))


@register
def op10_token_files(spark, sf_dir):
    """Documents written to flat token files and read back from them."""
    folder = shared_folder(spark, "token-files")
    write_token_files(
        table(spark, sf_dir, "documents"), folder, vocabulary("byte_bpe_50k.json"), end_id=0
    )
    return read_token_files(spark, folder)


@register
def op11_decontaminate(spark, sf_dir):
    """Words of each document that lie in ten words of a benchmark item, and the items met."""
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@register
def op12_repair_conversations(spark, sf_dir):
    """Faults of the damaged conversations, and their cheapest repair."""
    return audit_conversations(damage(table(spark, sf_dir, "conversations")), there_col="there")


@register
def op13_hard_negatives(spark, sf_dir):
    """Ten hard negatives for each of the five positives of every hundredth vector."""
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(vectors.withColumn("label", label), F.col("vec_id") % 100 == 0)
