"""Line deduplication by an exact set-similarity join: DataFrame functions only.

A line is the set of its words; lines without words always stay. It goes if an earlier line, by document
id and line number, has a set with a Jaccard similarity of ``percent`` or more.

* Tokens are 64-bit codes whose order is their rarity. Words are counted over the whole corpus by 65,536
  buckets of their hash, and a bucket's rank by its count leads the code. The array of ranks has a fixed
  size, so codes need no join, and as a code depends on the word alone, the order is the same in every line.
* Lines with equal sets are one; all but the first go at once, and only the first goes on.
* Two sets of n and m tokens can only be similar if they share one of their rarest
  ``n - ceil(t * n) + 1`` tokens (prefix filter), if neither is smaller than t times the other (length
  filter), and if enough tokens stand behind the shared one in both (positional filter). Sets too small to
  be similar to any other set than their equals are not looked for.
* A semi join over one shuffle of slim postings finds the lines for which such a partner exists at all; a
  sketch of the set lets few others through. Only those lines are read and cut again, with all their codes.
* Of the lines that share a rare token, each is first compared with the earliest of them alone. Only
  lines that this does not settle are compared with the other earlier ones, so a family of variants
  costs one comparison a line. Every pair that passes the filters is settled or verified on full sets.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from estatelens.llm.workers import free
from estatelens.operators.skew import SALTS, hot_keys
from estatelens.session import durable

BUCKET_BITS = 16
LOW_BITS = 64 - BUCKET_BITS
#: Bits of a code that bring postings together.
KEY_BITS = 40
#: Tokens up to which a line's sketch has 64 bits instead of 128.
SHORT_SKETCH = 64
#: What a line with words holds.
A_WORD = r"[^\x20\x09-\x0D]"
#: White space other than spaces and line feeds.
BLANK = "\t\x0b\x0c\r"


@dataclass(frozen=True)
class Alike:
    """Similarity in percent from which a later line goes."""

    percent: int = 80


def _words(text: Column) -> Column:
    """Words of a text without line feeds."""
    return F.array_remove(_pieces(text), "")


def _pieces(text: Column) -> Column:
    """Words of a text without line feeds, and empty strings. Splitting at one sign is quick; other white space is rare."""
    other = [F.contains(text, F.lit(c)) for c in BLANK]
    spaced = F.when(other[0] | other[1] | other[2] | other[3], F.regexp_replace(text, f"[{BLANK}]", " "))
    return F.split(F.coalesce(spaced, text), " ")


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, line, text) of all lines with words; lines count from 0."""
    lines = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(
        "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "text")
    )
    return lines.where(F.rlike("text", F.lit(A_WORD)))


def rarity(docs: DataFrame) -> Column:
    """For each bucket of words what turns its hashes into codes, by the bucket's rank over all texts.

    Words are counted by bucket before any shuffle; the driver sees one number per bucket. The numbers are a
    literal because lambdas take no subqueries. Each holds, in the bits of the bucket, the bucket xor its rank:
    xor with a hash leaves the rank there, so a code takes one operation. Ranks count from the least signed number on.
    """
    words = docs.select(F.explode(_pieces(F.replace("text", F.lit("\n"), F.lit(" ")))).alias("w")).where("w <> ''")
    counts = words.groupBy(_bucket(F.xxhash64("w")).alias("b")).count().collect()
    ranks = [0] * (1 << BUCKET_BITS)
    for rank, row in enumerate(sorted(counts, key=lambda r: (r["count"], r["b"]))):
        ranks[row["b"]] = rank
    half = 1 << (BUCKET_BITS - 1)
    turns = [((b ^ rank ^ half) - ((b ^ rank ^ half) >= half) * 2 * half) << LOW_BITS for b, rank in enumerate(ranks)]
    return F.split(F.lit(",".join(map(str, turns))), ",").cast("array<bigint>")


def _bucket(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - BUCKET_BITS).cast("int")


def _low(h: Column, bits: int) -> Column:
    return h.bitwiseAND(F.lit((1 << bits) - 1))


def _codes(line: Column, turns: Column) -> Column:
    """The distinct words of a line as codes, rarest first."""

    def code(h: Column) -> Column:
        return h.bitwiseXOR(F.coalesce(F.get(turns, _bucket(h)), F.lit(0).cast("long")))

    hashes = F.array_distinct(F.transform(_words(line), lambda w: F.xxhash64(w)))
    return F.sort_array(F.transform(hashes, code))


def _needed(n: Column, percent: int) -> Column:
    """ceil(t * n) in whole numbers."""
    return F.floor((n * percent + 99) / 100).cast("int")


def _earlier(doc_a, line_a, doc_b, line_b) -> Column:
    return (doc_a < doc_b) | ((doc_a == doc_b) & (line_a < line_b))


def _may_match(percent: int, named: str = "{0}_{1}") -> Column:
    """Length, positional and odd-sketch filter on the columns ``CARRIED`` of a and b, ``named`` by side.

    Sets of n and m tokens at the threshold t share t / (1 + t) * (n + m) tokens at least and differ in
    (1 - t) / (1 + t) * (n + m) at most, and their odd sketches in no more bits than that.
    """

    def of(name: str, side: str) -> Column:
        return F.col(named.format(name, side))

    n, m = of("n", "a"), of("n", "b")
    behind = F.least(n - of("i", "a"), m - of("i", "b"))
    low = of("low", "a").bitwiseXOR(of("low", "b"))
    high = of("high", "a").bitwiseXOR(of("high", "b"))
    # the 64-bit sketch of a set is that of 128 bits, folded
    apart = F.when(F.least(n, m) > SHORT_SKETCH, F.bit_count(low) + F.bit_count(high)).otherwise(
        F.bit_count(low.bitwiseXOR(high))
    )
    return (
        (F.least(n, m) * 100 >= F.greatest(n, m) * percent)
        & (behind * (100 + percent) >= (n + m) * percent)
        & (apart * (100 + percent) <= (n + m) * (100 - percent))
    )


def _sketch() -> dict[str, Column]:
    """``low`` and ``high``: the odd sketch of ``codes``, a bit per bucket, set if it holds an odd number of them.

    Sets of few tokens have one of 64 bits in ``low``.
    """

    def odd(which: str) -> Column:
        return F.expr(f"aggregate({which}, 0L, (bits, code) -> bits ^ shiftleft(1L, cast(code & 63 as int)))")

    few = F.size("codes") <= SHORT_SKETCH
    halves = [odd(f"filter(codes, code -> (code & 64) = {64 * half})") for half in (0, 1)]
    return {
        "low": F.when(few, odd("codes")).otherwise(halves[0]),
        "high": F.when(few, F.lit(0).cast("long")).otherwise(halves[1]),
    }


def _prefix(percent: int) -> Column:
    n = F.size("codes")
    return F.slice("codes", F.lit(1), n - _needed(n, percent) + 1)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(doc_b, line_b) of the pairs whose full sets are similar."""
    a = sets.select(F.col("doc_id").alias("doc_a"), F.col("line").alias("line_a"), F.col("codes").alias("x"))
    b = sets.select(F.col("doc_id").alias("doc_b"), F.col("line").alias("line_b"), F.col("codes").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    return (
        pairs.join(a.hint("merge"), ["doc_a", "line_a"])
        .join(b.hint("merge"), ["doc_b", "line_b"])
        .where(common * 100 >= (F.size("x") + F.size("y") - common) * percent)
        .select(F.col("doc_b").alias("doc_id"), F.col("line_b").alias("line"))
        .distinct()
    )


def repeated_lines(docs: DataFrame, like: Alike = Alike()) -> DataFrame:
    """(doc_id, line) of the lines of ``docs(doc_id, text)`` that an earlier one makes superfluous."""
    t = like.percent
    ranks = rarity(docs)
    coded = lines_of(docs).select("doc_id", "line", _codes(F.col("text"), ranks).alias("codes"))
    slim = durable(
        coded.select(
            "doc_id", "line", F.size("codes").alias("n"), F.xxhash64("codes").alias("set"), _prefix(t).alias("prefix"),
            *[c.alias(name) for name, c in _sketch().items()],
        )
    )

    placed = durable(_with_first(slim))
    # of the sets dealt out, the first lines of all deals meet here
    among = Window.partitionBy("set", "n").orderBy("doc_id", "line")
    dealt = _told(placed.where("dealt AND NOT again").drop("again"), among)
    equal = placed.where("again").unionByName(dealt.where("again")).select("doc_id", "line")
    # a set of n tokens is only ever similar to another one if n / (n + 1) reaches the threshold
    firsts = placed.where("NOT dealt AND NOT again").unionByName(dealt.where("NOT again"))
    firsts = firsts.where(F.col("n") * 100 >= (F.col("n") + 1) * t)
    lines = durable(_plausible(_postings(firsts), t))
    sets = durable(_again(docs, lines, ranks).withColumns({"n": F.size("codes"), "prefix": _prefix(t)} | _sketch()))
    postings = durable(_with_heads(_postings(sets)))

    # each line and the earliest that shares a rare token with it
    others = postings.where("doc_a IS NOT NULL").withColumnsRenamed(_sided("b"))
    keys = ["doc_a", "line_a", "doc_b", "line_b"]
    first_pairs = durable(others.where(_may_match(t)).select(*keys).distinct())
    settled = durable(_verified(first_pairs, sets, t))

    # lines that are still open, and all earlier ones; a line is told by its key before its postings are made
    still = sets.drop("codes").join(settled.hint("merge"), ["doc_id", "line"], "left_anti")
    open_ = _postings(still).withColumnsRenamed(_sided("b"))
    earlier = postings.select("code", *CARRIED).withColumnsRenamed(_sided("a"))
    before = _earlier(F.col("doc_a"), F.col("line_a"), F.col("doc_b"), F.col("line_b"))
    rest = open_.join(earlier, "code").where(before & _may_match(t))
    more_pairs = durable(rest.select(*keys).distinct().join(first_pairs, keys, "left_anti"))
    more = _verified(more_pairs, sets, t)
    return durable(equal.unionAll(settled).unionAll(more).distinct())


def _told(lines: DataFrame, by_set: WindowSpec) -> DataFrame:
    """The first line of each group and, with ``again``, those at later places.

    Rows that repeat the first line's id and number are left out.
    """
    upto = by_set.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = {"at": F.row_number().over(by_set)} | {f"{c}_a": F.first(c).over(upto) for c in ("doc_id", "line")}
    later = (F.col("doc_id") > F.col("doc_id_a")) | (F.col("line") > F.col("line_a"))
    found = lines.withColumns(first).where((F.col("at") == 1) | later).withColumn("again", F.col("at") > 1)
    return found.drop(*first)


def _with_first(slim: DataFrame) -> DataFrame:
    """Lines of equal sets told apart: ``again`` is false for the first of each set, true for those that go.

    One shuffle by set: a running window carries the first line along. The few sets that hold a large share of
    all lines would be one task each; they are dealt out (``dealt``), and each deal has a first line.
    """
    keys = ["set", "n"]
    hot = hot_keys(slim, keys, [*keys, "doc_id", "line"]).scalar()
    is_hot = F.coalesce(F.array_contains(hot, F.xxhash64(*keys)), F.lit(False))
    deal = F.when(F.col("dealt"), F.pmod(F.xxhash64("doc_id", "line"), F.lit(SALTS))).otherwise(F.lit(0))
    dealt = slim.withColumn("dealt", is_hot).withColumn("deal", deal)
    by_set = Window.partitionBy(*keys, "deal").orderBy("doc_id", "line")
    return _told(dealt, by_set).drop("deal")


def _postings(lines: DataFrame) -> DataFrame:
    each = lines.select("doc_id", "line", "n", "low", "high", F.posexplode("prefix").alias("i", "code"))
    return each.withColumn("code", _low(F.col("code"), KEY_BITS))


def _plausible(postings: DataFrame, percent: int) -> DataFrame:
    """(doc_id, line) of the lines that share a code with another line and pass the filters with it.

    A semi join stops at the first such line and writes no pairs. Both sides are the same rows dealt by code,
    so they share one shuffle.
    """
    # both sides are the same plan down to the order of columns, or the shuffle would be made twice
    a, b = postings.alias("a"), postings.alias("b")
    other = (F.col("a.doc_id") != F.col("b.doc_id")) | (F.col("a.line") != F.col("b.line"))
    same = F.col("a.code") == F.col("b.code")
    partner = same & _may_match(percent, "{1}.{0}") & other
    return b.join(a, partner, "left_semi").select("doc_id", "line").distinct()


#: What a posting says of its line.
CARRIED = ("doc_id", "line", "n", "i", "low", "high")


def _sided(side: str) -> dict[str, str]:
    return {c: f"{c.removesuffix('_id')}_{side}" for c in CARRIED}


def _with_heads(postings: DataFrame) -> DataFrame:
    """Postings of codes that several lines share, each with the earliest line of its code.

    One shuffle by code: a running window carries the first line along. The few codes that hold a large
    share of all postings would be one task each; they are left out of the window, and their first line
    is found by combining minima.
    """
    hot = hot_keys(postings, ["code"], ["code", "doc_id", "line"]).scalar()
    is_hot = F.array_contains(hot, F.xxhash64("code"))
    by_code = Window.partitionBy("code").orderBy("doc_id", "line")
    upto = by_code.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = _sided("a")
    heads = {name: F.first(c).over(upto) for c, name in first.items()}
    cold = (
        postings.where(~F.coalesce(is_hot, F.lit(False)))
        .withColumns(heads | {"next": F.lead("line").over(by_code), "at": F.row_number().over(by_code)})
        .where("at > 1 OR next IS NOT NULL")
        .withColumns({name: F.when(F.col("at") > 1, F.col(name)) for name in first.values()})
        .drop("at", "next")
    )
    warm = postings.where(F.coalesce(is_hot, F.lit(False)))
    docs = warm.groupBy("code").agg(F.min("doc_id").alias("doc_a"))
    head_rows = (
        warm.join(docs, "code")
        .where("doc_id = doc_a")
        .select("code", *[F.col(c).alias(name) for c, name in first.items()])
    )
    least = head_rows.groupBy("code").agg(F.min("line_a").alias("line_a"))
    found = head_rows.join(least, ["code", "line_a"]).dropDuplicates(["code"])
    itself = (F.col("doc_id") == F.col("doc_a")) & (F.col("line") == F.col("line_a"))
    hot_rows = warm.join(found, "code").withColumn("itself", itself)
    hot_rows = hot_rows.withColumns(
        {name: F.when(~F.col("itself"), F.col(name)) for name in first.values()}
    ).drop("itself")
    return cold.unionByName(hot_rows)


def _again(docs: DataFrame, lines: DataFrame, ranks: Column) -> DataFrame:
    """(doc_id, line, codes) of some lines, cut from the texts of their documents again.

    The numbers of a document's lines come to its text, so texts are shuffled once, by document. Of rows that
    repeat an id, the lines of one number are one line here as before: any of them stands for it.
    """

    def line_at(i: Column) -> Column:
        return F.struct(i.alias("line"), F.get("parts", i).alias("text"))

    wanted = lines.groupBy("doc_id").agg(F.collect_list("line").alias("wanted"))
    found = (
        docs.where("text IS NOT NULL")
        .join(wanted.hint("shuffle_hash"), "doc_id")
        .select("doc_id", "wanted", F.split("text", "\n", -1).alias("parts"))
        # numbers and lines go together before they become rows, so no row carries a whole text
        .select("doc_id", F.explode(F.transform("wanted", line_at)).alias("w"))
        .where(F.rlike("w.text", F.lit(A_WORD)))
    )
    coded = found.select("doc_id", "w.line", _codes(F.col("w.text"), ranks).alias("codes"))
    return coded.dropDuplicates(["doc_id", "line"])


def _marked(docs: DataFrame, like: Alike, id_col: str, text_col: str) -> tuple[DataFrame, Column, Column]:
    """``docs`` with the lines that go, and the columns of the document's id and of these lines."""
    key, gone, of = (free(name, docs) for name in ("doc_key", "gone_lines", "gone_doc"))
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    lines = repeated_lines(slim, like).groupBy(F.col("doc_id").alias(of)).agg(F.collect_list("line").alias(gone))
    marked = docs.withColumn(key, F.col(f"`{id_col}`").cast("long"))
    # by a shuffle at every size, as the lines grow with the documents
    return marked.join(durable(lines).hint("shuffle_hash"), F.col(key) == F.col(of), "left"), F.col(key), F.col(gone)


def _kept_text(text: Column, gone: Column) -> Column:
    kept = F.filter(F.split(text, "\n", -1), lambda line, i: ~F.array_contains(gone, i))
    return F.when(gone.isNull(), text).otherwise(F.array_join(kept, "\n"))


def dedup_lines(
    docs: DataFrame, like: Alike = Alike(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` without the lines that an earlier line makes superfluous; all rows and columns stay.

    Lines are what stands between line feeds; they may be of any length, and of lines that are similar to each
    other the first one stays. A null text stays null, an empty one empty, and a text that
    loses all its lines becomes empty. Rows without an id are left as they are. Rows that repeat an id are
    one document: their lines of one number are no earlier and later ones, and what goes, goes from all.
    An empty table stays empty.
    """
    marked, _, gone = _marked(docs, like, id_col, text_col)
    text = F.col(f"`{text_col}`")
    return marked.select(
        *[_kept_text(text, gone).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    )


def line_report(
    docs: DataFrame, like: Alike = Alike(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row: doc_id, n_lines, n_removed and the text that is left; nulls as in ``dedup_lines``."""
    marked, key, gone = _marked(docs, like, id_col, text_col)
    text = F.col(f"`{text_col}`")
    return marked.select(
        key.alias("doc_id"),
        F.coalesce(F.size(F.split(text, "\n", -1)), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_removed"),
        _kept_text(text, gone).alias("text"),
    )
