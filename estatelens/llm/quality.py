"""Quality rules: counts of each document, and lines that too many documents of a host carry.

One pass over the texts makes a narrow table with the counts of each document and, for each of its
distinct lines, a hash of the normalised line (words in A-Z lower case, one space between them) and the
words it holds there. A line's documents are counted per host; texts that are copies of each other in a
host count as one document, so that copies do not turn a text of its own into boilerplate. Lines found
in more than ``share_percent`` of a host's documents are removed, if more than two documents carry them:
what one or two have is no habit of a host, however few documents it has. The share is the same for hosts
of every size. A document that loses more than half of its words that way is depleted and rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from estatelens.llm.words import words_of
from estatelens.llm.workers import free, slices, utf8
from estatelens.operators.skew import spread_join
from estatelens.session import durable

SYMBOLS = "[#*$%&|<>]"


@dataclass(frozen=True)
class Rules:
    """Limits: words a document needs, percent of them in repeated windows, percent of a host's texts
    that may carry a line, texts that make a habit, and percent of words a document may lose."""

    min_words: int = 50
    repeat_percent: int = 50
    window: int = 3
    share_percent: int = 10
    least: int = 3
    lost_percent: int = 50


def line_hash(line: bytes) -> tuple[int, int]:
    """Hash of the normalised line as a signed 64-bit number, and its words; (0, 0) without words."""
    words = line.lower().split()
    if not words:
        return 0, 0
    h = xxhash.xxh3_64_intdigest(b" ".join(words))
    return h - (1 << 64) if h >> 63 else h, len(words)


def repeated(windows: np.ndarray, n_words: int, k: int) -> int:
    """Words inside windows of ``k`` words that occur twice or more."""
    if len(windows) < 2:
        return 0
    _, which, counts = np.unique(windows, return_inverse=True, return_counts=True)
    twice = counts[which] > 1
    inside = np.zeros(n_words, dtype=bool)
    for i in range(k):
        inside[i : i + len(twice)] |= twice
    return int(inside.sum())


def document_counts(docs: DataFrame, k: int) -> DataFrame:
    """Counts and lines per row of ``docs(row, doc_id, host, text_hash, text)``, without the text."""

    def count(batches):
        for batch in slices(batches, 4):
            texts = batch.column(4).fill_null("")
            words = words_of(texts)
            windows = words.windows(k)
            n_words = np.diff(words.edges)
            blank = pc.count_substring_regex(texts, "[\\x20\\x09-\\x0D]").to_numpy()
            chars = pc.utf8_length(texts).to_numpy().astype(np.int64) - blank
            repeats, twice, lines = [], [], []
            for i, text in enumerate(utf8(texts)):
                start, n = int(words.edges[i]), int(n_words[i])
                repeats.append(repeated(windows[start : start + max(n - k + 1, 0)], n, k))
                raw, own, again = set(), {}, 0
                for line in text.split(b"\n"):
                    h, size = line_hash(line)
                    if size:
                        again += line in raw
                        raw.add(line)
                        own[h] = own.get(h, 0) + size
                twice.append(again)
                lines.append([{"hash": h, "words": n} for h, n in own.items()])
            line = pa.struct([("hash", pa.int64()), ("words", pa.int64())])
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:4],
                    pa.array(n_words, type=pa.int64()),
                    pa.array(chars, type=pa.int64()),
                    pc.count_substring_regex(texts, SYMBOLS).cast(pa.int64()),
                    pa.array(twice, type=pa.int64()),
                    pa.array(repeats, type=pa.int64()),
                    pa.array(lines, type=pa.list_(line)),
                ],
                names=[f.split()[0] for f in COUNTS.split(", ")],
            )

    return docs.mapInArrow(count, COUNTS)


COUNTS = (
    "row long, doc_id long, host string, text_hash long, n_words long, word_chars long, "
    "n_symbols long, n_dup_lines long, n_repeat_words long, lines array<struct<hash:long,words:long>>"
)


def _host(host_col: str):
    """Rows without a host are a host of their own."""
    return F.coalesce(F.col(host_col).cast("string"), F.lit("\0"))


def judged(
    docs: DataFrame,
    rules: Rules = Rules(),
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
) -> DataFrame:
    """Counts and verdict per row: those of ``COUNTS``, and base_failed, kept, lost (words in removed
    lines) and gone (hashes of the removed lines, null where none)."""
    slim = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).cast("long").alias("doc_id"),
        _host(host_col).alias("host"),
        F.xxhash64(text_col).alias("text_hash"),
        F.col(text_col).alias("text"),
    )
    counts = durable(document_counts(slim, rules.window))

    texts = counts.groupBy("host", "text_hash").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    copies = (
        spread_join(
            counts.select("row", "host", "text_hash"), texts.where("n > 1"), ["host", "text_hash"]
        )
        .where("row <> first")
        .select("row")
    )
    sizes = texts.groupBy("host").agg(F.count("*").alias("texts"))
    lines = counts.select("row", "host", F.explode("lines").alias("line")).select(
        "row", "host", "line.hash", "line.words"
    )
    frequent = durable(
        lines.join(copies, "row", "left_anti")
        .groupBy("host", "hash")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= rules.least)
        .join(sizes, "host")
        .where(F.col("n") * 100 > F.col("texts") * rules.share_percent)
        .select("host", "hash")
    )
    lost = (
        spread_join(lines, frequent, ["host", "hash"])
        .groupBy("row")
        .agg(F.sum("words").alias("lost"), F.collect_list("hash").alias("gone"))
    )
    failed = (F.col("n_words") < rules.min_words) | (
        100 * F.col("n_repeat_words") > rules.repeat_percent * F.col("n_words")
    )
    some = F.coalesce("lost", F.lit(0))
    return (
        counts.drop("lines")
        .join(lost, "row", "left")
        .withColumn("lost", some)
        .withColumn("base_failed", failed)
        .withColumn(
            "kept", ~F.col("base_failed") & (100 * some <= rules.lost_percent * F.col("n_words"))
        )
    )


def quality(
    docs: DataFrame,
    rules: Rules = Rules(),
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
) -> DataFrame:
    """Per row: doc_id, the counts, base_failed, kept, and n_removed_words.

    A null text has no words and fails the base rules, as an empty one does. Rows without a host are a
    host of their own; rows that repeat a text in a host are one document there, but each gives a row. An
    empty table gives none. Whole texts of any length are counted; a share that is just the limit is
    within it. Columns other than the three named are not read.
    """
    return judged(docs, rules, id_col, text_col, host_col).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        F.col("lost").alias("n_removed_words"),
    )


@F.pandas_udf(StringType())
def _without(texts, gone):
    def clean(text, hashes):
        hashes = set(hashes)
        lines = text.encode().split(b"\n")
        return b"\n".join(x for x in lines if line_hash(x)[0] not in hashes).decode()

    import pandas as pd

    return pd.Series([clean(t, g) if g is not None else t for t, g in zip(texts, gone)], dtype=object)


def good_documents(
    docs: DataFrame,
    rules: Rules = Rules(),
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
) -> DataFrame:
    """``docs`` without rejected documents and, in the others, without the removed lines.

    Same columns as before, whatever their names; whole texts of any length are looked at. Null and empty texts
    have no words and are rejected; an empty table stays empty. A verdict finds its row by id, host and a hash of the text, so rows that are
    the same in these have the same verdict, and ids may be null or repeat.
    """
    names = ("verdict_id", "verdict_host", "verdict_hash", "gone_lines", "doc_key", "doc_host", "doc_hash")
    q_id, q_host, q_hash, gone, d_id, d_host, d_hash = (free(name, docs) for name in names)
    verdicts = (
        judged(docs, rules, id_col, text_col, host_col)
        .where("kept")
        .select(
            F.col("doc_id").alias(q_id),
            F.col("host").alias(q_host),
            F.col("text_hash").alias(q_hash),
            F.col("gone").alias(gone),
        )
        .dropDuplicates([q_id, q_host, q_hash])
    )
    text = F.col(f"`{text_col}`")
    marked = docs.select(
        "*",
        F.col(id_col).cast("long").alias(d_id),
        _host(host_col).alias(d_host),
        F.xxhash64(text_col).alias(d_hash),
    )
    same = (
        F.col(d_id).eqNullSafe(F.col(q_id))
        & (F.col(d_host) == F.col(q_host))
        & (F.col(d_hash) == F.col(q_hash))
    )
    kept = marked.join(verdicts, same)
    cleaned = F.when(F.col(gone).isNull(), text).otherwise(_without(text, F.col(gone)))
    return kept.select(
        *[cleaned.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    )
