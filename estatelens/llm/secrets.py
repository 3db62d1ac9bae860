"""Secrets in texts, and who owns them: DataFrame functions only.

Candidates are found per kind: a pattern cuts a text into what stands between matches, so the lengths of
the parts give every match its place in code points. Their values are then counted over the corpus: in
how many repositories and at how many owners each occurs, copies of a text counting once. Every value has
a verdict. It is a *copied* example if many owners carry it, or if more owners than one do in many
repositories. Else it belongs to its owners, however many repositories of one owner hold it: it is *live*
if it looks like a real credential and *unlikely* if not. The verdict adds a span over the value itself;
spans of the base kinds stay as they are.

Texts are read once. What goes on is one row per match; counts first combine rows of one value and one
repository, then those of one owner, so a value in a third of all texts is a few rows by then, and the
rows that look its verdict up are dealt out by ``spread_join``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from estatelens.llm.workers import free
from estatelens.operators.skew import spread_join
from estatelens.session import durable

#: Base kinds in the order of their spans: pattern, group that holds the value, its least length.
#: The last two patterns hold their least length: a run that is too short holds no longer one.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = {
    "assign": (ASSIGN, 2, 8),
    "access": (r"AKIA[A-Z0-9]{12,}", 0, 16),
    "hex": (r"[0-9a-f]{32,}", 0, 32),
}
#: Kinds that the ownership counts add.
ADDED = ("live", "copied", "unlikely")
#: Values that hold one of these are made up (any case).
MADE_UP = "example|sample|dummy|changeme|placeholder|your_|xxxx|1234567890|0000000|abcdefgh"


@dataclass(frozen=True)
class Ownership:
    """Owners that make a value a copied one, repositories that do so at two owners or more, and different
    signs a real value has."""

    copied_owners: int = 3
    copied_repos: int = 5
    distinct_signs: int = 6


def _parts(text: Column, kind: str) -> Column:
    """Lengths of the parts before each match, and the matches; null where there is none."""
    pattern = F.lit(KINDS[kind][0])
    before = F.transform(F.split(text, KINDS[kind][0], -1), lambda part: F.length(part))
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    return F.when(F.rlike(text, pattern), F.arrays_zip(before.alias("before"), found.alias("match")))


def matches(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, spans) of ``docs(doc_id, repo, owner, text)``.

    rows: row, doc_id, text_hash. spans: row, repo, owner, text_hash, kind, at (order of the kind), start,
    end, from (where the value starts), value; code points, end exclusive.
    """
    found = durable(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            "repo",
            "owner",
            F.xxhash64("text").alias("text_hash"),
            *[_parts(F.coalesce("text", F.lit("")), kind).alias(kind) for kind in KINDS],
        )
    )
    upto = Window.partitionBy("row").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    spans = None
    for at, (kind, (pattern, group, least)) in enumerate(KINDS.items()):
        each = found.where(F.col(kind).isNotNull()).select(
            "row", "repo", "owner", "text_hash", F.posexplode(kind).alias("i", "part")
        )
        each = each.select(
            *["row", "repo", "owner", "text_hash", "i"],
            F.col("part.before").alias("before"),
            F.col("part.match").alias("match"),
        )
        end = F.sum(F.col("before") + F.coalesce(F.length("match"), F.lit(0))).over(upto)
        value = F.regexp_extract("match", pattern, group) if group else F.col("match")
        one = (
            each.withColumn("end", end)
            .where(F.col("match").isNotNull())
            .withColumn("value", value)
            .where(F.length("value") >= least)
            .select(
                "row",
                "repo",
                "owner",
                "text_hash",
                F.lit(kind).alias("kind"),
                F.lit(at).alias("at"),
                (F.col("end") - F.length("match")).alias("start"),
                "end",
                (F.col("end") - F.length("value")).alias("from"),
                "value",
            )
        )
        spans = one if spans is None else spans.unionAll(one)
    return found.select("row", "doc_id", "text_hash"), spans


def ownership(spans: DataFrame, rule: Ownership) -> DataFrame:
    """(value_hash, owners, repos, verdict) of every value; a text's copies count at their smallest place."""
    place = F.min(F.struct("owner", "repo")).alias("place")
    valued = (
        spans.groupBy(F.xxhash64("value").alias("value_hash"), "text_hash")
        .agg(place, F.first("value").alias("value"))
        .select("value_hash", "place.owner", "place.repo", "value")
    )
    places = valued.groupBy("value_hash", "owner", "repo").agg(F.first("value").alias("value"))
    owners = places.groupBy("value_hash", "owner").agg(
        F.count("*").alias("repos"), F.first("value").alias("value")
    )
    counts = owners.groupBy("value_hash").agg(
        F.count("*").alias("owners"), F.sum("repos").alias("repos"), F.first("value").alias("value")
    )
    value = F.col("value")
    real = (
        (F.size(F.array_distinct(F.split(value, ""))) >= rule.distinct_signs)
        & F.rlike(value, F.lit("[0-9]"))
        & ~F.rlike(value, F.lit(f"(?i){MADE_UP}"))
    )
    copied = (F.col("owners") >= rule.copied_owners) | (
        (F.col("owners") > 1) & (F.col("repos") >= rule.copied_repos)
    )
    live, widely, unlikely = (F.lit(kind) for kind in ADDED)
    verdict = F.when(copied, widely).when(real, live).otherwise(unlikely)
    return counts.select("value_hash", "owners", "repos", verdict.alias("verdict"))


def added_spans(spans: DataFrame, rule: Ownership) -> DataFrame:
    """(row, kind, at, start, end) of the values by their verdicts."""
    valued = spans.select("row", "from", "end", F.xxhash64("value").alias("value_hash"))
    return (
        spread_join(valued, ownership(spans, rule), ["value_hash"])
        .select(
            "row",
            F.col("verdict").alias("kind"),
            (F.array_position(F.array(*map(F.lit, ADDED)), F.col("verdict")) - 1 + len(KINDS)).alias("at"),
            F.col("from").alias("start"),
            "end",
        )
        .distinct()
    )


def _inputs(docs: DataFrame, id_col: str, text_col: str, owner_col: str, repo_col: str) -> DataFrame:
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).alias("text"),
        F.col(owner_col).cast("string").alias("owner"),
        F.col(repo_col).cast("string").alias("repo"),
    )


def find_secrets(
    docs: DataFrame,
    rule: Ownership = Ownership(),
    id_col: str = "doc_id",
    text_col: str = "text",
    owner_col: str = "source",
    repo_col: str = "lang",
) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied, n_unlikely.

    A repository is a value of ``repo_col`` at one owner. Null owners and repositories are one of their
    own, and stand before all others. A null text is an empty one: no spans; texts of any length are
    searched whole. Every row gives one row, also if it repeats another; equal texts count once for the
    owners and repositories of a value. An empty table gives none. Spans that start together stand in the
    order of their kinds. Columns other than the four named are not read.
    """
    rows, spans = matches(_inputs(docs, id_col, text_col, owner_col, repo_col))
    spans = durable(spans)
    added = added_spans(spans, rule)
    all_spans = spans.select("row", "kind", "at", "start", "end").unionAll(added)
    said = F.concat_ws(":", "kind", "start", "end")
    base = F.col("at") < len(KINDS)

    def listed(which: Column | None) -> Column:
        entry = F.struct("start", "at", "end", said.alias("said"))
        entries = F.sort_array(F.collect_list(entry if which is None else F.when(which, entry)))
        return F.array_join(F.transform(entries, lambda e: e["said"]), ",")

    names = [*KINDS, *ADDED]
    per_row = all_spans.groupBy("row").agg(
        *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in names],
        listed(base).alias("base"),
        listed(None).alias("spans"),
    )
    none = F.lit("")
    return rows.join(per_row, "row", "left").select(
        "doc_id",
        *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.coalesce("base", none), 256).alias("base_sha256"),
        F.coalesce("spans", none).alias("spans"),
        *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in ADDED],
    )


def redact(
    docs: DataFrame,
    mask: str = "<secret>",
    rule: Ownership = Ownership(),
    id_col: str = "doc_id",
    text_col: str = "text",
    owner_col: str = "source",
    repo_col: str = "lang",
) -> DataFrame:
    """``docs`` with ``mask`` in place of every live value; others stay.

    Same rows and columns as before, whatever their names; null texts stay null, empty ones and empty tables
    empty, and texts of any length are masked whole. A row finds its spans by id and a hash of its text, so ids may be
    null or repeat. Spans that overlap are masked as one.
    """
    rows, spans = matches(_inputs(docs, id_col, text_col, owner_col, repo_col))
    spans = durable(spans)
    live = added_spans(spans, rule).where(F.col("kind") == ADDED[0])
    order = Window.partitionBy("row").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(F.coalesce(before > F.col("start"), F.lit(False)), 0).otherwise(1)
    runs = (
        live.withColumn("opens", opens)
        .withColumn("run", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("row", "run")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"))
        .groupBy("row")
        .agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("runs"))
    )
    names = ("secret_runs", "secret_id", "secret_hash", "doc_key", "doc_hash")
    runs_name, s_id, s_hash, d_id, d_hash = (free(name, docs) for name in names)
    by_text = durable(
        rows.join(runs, "row")
        .select(F.col("doc_id").alias(s_id), F.col("text_hash").alias(s_hash), F.col("runs").alias(runs_name))
        .dropDuplicates([s_id, s_hash])
    )
    text = F.col(f"`{text_col}`")
    runs_of = F.col(runs_name)
    starts = F.concat(F.array(F.lit(0).cast("long")), runs_of["end"])
    ends = F.concat(runs_of["start"], F.array(F.length(text).cast("long")))
    kept = F.transform(
        F.arrays_zip(starts.alias("a"), ends.alias("b")),
        lambda e: F.substring(text, (e["a"] + 1).cast("int"), (e["b"] - e["a"]).cast("int")),
    )
    masked = F.when(runs_of.isNull(), text).otherwise(F.array_join(kept, mask))
    marked = docs.select("*", F.col(id_col).cast("long").alias(d_id), F.xxhash64(text_col).alias(d_hash))
    same = F.col(d_id).eqNullSafe(F.col(s_id)) & (F.col(d_hash) == F.col(s_hash))
    return marked.join(by_text, same, "left").select(
        *[masked.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    )
