"""Best-fit packing of token sequences by the counts of their lengths.

Lengths are whole numbers up to the capacity, so what a packer has to know of the corpus is how many
pieces there are of each length: a table bounded by the capacity, whatever the corpus holds. The plan is
made from those counts alone:

* pieces above a third of the capacity (large) share a sequence with at most one other large piece. The
  longest is matched with the longest partner that fits, length by length;
* smaller pieces, longest first, go where the gap left is smallest, and open a new sequence only where
  no gap is wide enough.

Sequences with the same contents are one *layout* with a number of copies, so thousands of millions of
sequences are a few thousand layouts. Each layout takes a range of the pieces of a length, and a piece
finds its place by its rank among the pieces of its length. Ranks need no window over the corpus: a task
counts per length as it reads, and prefix sums over tasks turn its counts into ranks.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from estatelens.llm.byte_bpe import Encoder
from estatelens.llm.workers import kept, strings
from estatelens.session import durable

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``total`` tokens: only the first may be shorter."""
    if total <= 0:
        return []
    first = total % capacity or min(total, capacity)
    return [(0, first)] + [(start, capacity) for start in range(first, total, capacity)]


class Layouts:
    """Layouts and how many sequences have each, found by best fit over counts.

    ``groups``: gap -> list of [copies, contents], contents a tuple of (length, times).
    """

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.gaps: list[int] = []  # those with a group, sorted
        self.groups: dict[int, list] = {}

    def put(self, gap: int, copies: int, contents: tuple) -> None:
        if copies:
            if gap not in self.groups:
                bisect.insort(self.gaps, gap)
                self.groups[gap] = []
            self.groups[gap].append((copies, contents))

    def take(self, gap: int) -> tuple[int, tuple]:
        group = self.groups[gap].pop()
        if not self.groups[gap]:
            del self.groups[gap]
            self.gaps.remove(gap)
        return group

    def match_large(self, counts: dict[int, int], third: float) -> None:
        """Longest first, each with the longest other large piece that still fits."""
        left = {n: c for n, c in counts.items() if n > third and c}
        lengths = sorted(left)
        while lengths:
            n = lengths[-1]
            partner = bisect.bisect_right(lengths, self.capacity - n) - 1
            if partner < 0:
                self.put(self.capacity - n, left[n], ((n, 1),))
                lengths.pop()
                continue
            m = lengths[partner]
            if m == n:
                pairs, odd = divmod(left[n], 2)
                self.put(self.capacity - 2 * n, pairs, ((n, 2),))
                left[n] = odd
                if odd:
                    lengths.pop()
                    # one is left over: its partner is the next shorter one, if any
                    if lengths:
                        m = lengths[-1]
                        self.put(self.capacity - n - m, 1, ((n, 1), (m, 1)))
                        left[m] -= 1
                        if not left[m]:
                            lengths.pop()
                    else:
                        self.put(self.capacity - n, 1, ((n, 1),))
                else:
                    lengths.pop()
                continue
            pairs = min(left[n], left[m])
            self.put(self.capacity - n - m, pairs, ((n, 1), (m, 1)))
            for length in (n, m):
                left[length] -= pairs
                if not left[length]:
                    lengths.remove(length)

    def fit_small(self, counts: dict[int, int], third: float) -> None:
        """Longest first, each into the smallest gap that holds it."""
        for n in sorted((n for n, c in counts.items() if n <= third and c), reverse=True):
            left = counts[n]
            # best fit: a sequence that took one of this length is the tightest for the next one
            while left:
                at = bisect.bisect_left(self.gaps, n)
                if at == len(self.gaps):
                    self.put(self.capacity, -(-left // (self.capacity // n)), ())
                    continue
                gap = self.gaps[at]
                copies, contents = self.take(gap)
                each = gap // n
                full = min(copies, left // each)
                self.put(gap - each * n, full, (*contents, (n, each)))
                left -= full * each
                copies -= full
                if copies and left < each:  # the last, partly filled sequence
                    if left:
                        self.put(gap - left * n, 1, (*contents, (n, left)))
                        copies -= 1
                        left = 0
                self.put(gap, copies, contents)

    def ranges(self):
        """Arrays by length: first rank of a range, sequence base, pieces per sequence, offset."""
        taken: dict[int, int] = {}
        out: dict[int, list] = {}
        base = 0
        for gap in self.gaps:
            for copies, contents in self.groups[gap]:
                if not contents:
                    continue
                offset = 0
                for n, times in contents:
                    first = taken.get(n, 0)
                    out.setdefault(n, []).append((first, base, times, offset))
                    taken[n] = first + copies * times
                    offset += n * times
                base += copies
        return {n: np.array(rows, dtype=np.int64).T for n, rows in out.items()}


def plan_layouts(counts: dict[int, int], capacity: int) -> Layouts:
    """The layouts for ``counts`` pieces of each length."""
    layouts = Layouts(capacity)
    third = capacity / 3
    layouts.match_large(counts, third)
    layouts.fit_small(counts, third)
    return layouts


def place(pieces: DataFrame, capacity: int, length: str = "length") -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: its place in a sequence of ``capacity``.

    Rows without a length, or with one outside 1..capacity, get null for both. Rows are written once to
    the checkpoint folder with their rank in the task, so that a lost executor changes no rank. What the
    driver sees is one count per length, at most ``capacity`` rows. Other columns stay as they are;
    columns named ``sequence_id`` or ``offset`` are replaced, and names starting ``_pack`` are reserved.
    """
    pieces = pieces.drop("sequence_id", "offset")
    schema = pieces.schema
    at = schema.fieldNames().index(length)
    full = pa_schema_of(pieces, {"_pack_task": pa.int32(), "_pack_rank": pa.int64()})

    def ranked(batches):
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            n = batch.column(at).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
            n = np.where((n < 1) | (n > capacity), 0, n)
            order = np.argsort(n, kind="stable")
            ordered = n[order]
            first = np.searchsorted(ordered, ordered)  # where the run of the same length starts
            rank = np.empty(len(n), dtype=np.int64)
            rank[order] = np.arange(len(n)) - first + seen[ordered]
            seen += np.bincount(n, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(n), task, np.int32)), pa.array(rank)],
                schema=full,
            )

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    stored = durable(pieces.mapInArrow(ranked, f"{types}, _pack_task int, _pack_rank long"))
    return _placed(stored, capacity, length)


def pa_schema_of(df: DataFrame, more: dict) -> pa.Schema:
    """The Arrow form of a DataFrame's columns, with more at the end."""
    from pyspark.sql.pandas.types import to_arrow_schema

    known = to_arrow_schema(df.schema)
    return pa.schema([*known, *(pa.field(name, kind) for name, kind in more.items())])


def _placed(stored: DataFrame, capacity: int, length: str) -> DataFrame:
    """Places from the ranks in tasks: prefix sums over tasks, then the ranges of the layouts."""
    n = F.col(length)
    fits = stored.where(n.between(1, capacity))
    by_task = fits.groupBy("_pack_task", n.alias("_pack_n")).agg(F.count("*").alias("_pack_c"))
    counts = {
        int(r["_pack_n"]): r["c"]
        for r in by_task.groupBy("_pack_n").agg(F.sum("_pack_c").alias("c")).collect()
    }
    ranges = plan_layouts(counts, capacity).ranges()
    before = Window.partitionBy("_pack_n").orderBy("_pack_task").rowsBetween(
        Window.unboundedPreceding, -1
    )
    bases = by_task.select(
        F.col("_pack_task").alias("_pack_t"),
        "_pack_n",
        F.coalesce(F.sum("_pack_c").over(before), F.lit(0)).alias("_pack_base"),
    )
    joined = stored.join(
        bases,
        (stored["_pack_task"] == bases["_pack_t"]) & (stored[length] == bases["_pack_n"]),
        "left",
    ).drop("_pack_t", "_pack_n", "_pack_task")
    names = [c for c in joined.columns if not c.startswith("_pack")]
    table = joined.sparkSession.sparkContext.broadcast(ranges)  # at most a few ranges per length

    @F.pandas_udf("sequence_id long, offset long")
    def places(lengths, base, rank):
        import pandas as pd

        n = lengths.fillna(0).to_numpy(dtype=np.int64)
        r = (base.fillna(0) + rank.fillna(0)).to_numpy(dtype=np.int64)
        sequence, offset = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        for value in np.unique(n):
            known = table.value.get(int(value))
            if known is None:
                continue
            rows = np.flatnonzero(n == value)
            first, start, times, begin = known
            at = np.searchsorted(first, r[rows], side="right") - 1
            inside = r[rows] - first[at]
            sequence[rows] = start[at] + inside // times[at]
            offset[rows] = begin[at] + inside % times[at] * value
        known = np.isin(n, list(table.value))
        return pd.DataFrame(
            {
                "sequence_id": pd.Series(sequence).astype("Int64").where(known),
                "offset": pd.Series(offset).astype("Int64").where(known),
            }
        )

    spot = places(F.col(length).cast("long"), F.col("_pack_base"), F.col("_pack_rank"))
    return joined.withColumn("_pack_at", spot).select(
        *[F.col(f"`{c}`") for c in names], F.col("_pack_at.sequence_id"), F.col("_pack_at.offset")
    )


def token_pieces(
    docs: DataFrame,
    tokenizer: str,
    capacity: int,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Each document's ids and ``end_id``, cut into pieces of at most ``capacity`` tokens.

    One row per piece: doc_id, piece, start, length, the CRC-32 of its ids as 32-bit integers, and the
    ids themselves where ``with_ids``. A null text is an empty one: a single piece with the end id.
    Rows that repeat a document give their pieces again; an empty table gives none.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def pieces(batches):
        encoder = kept(("byte_bpe", tokenizer), lambda: Encoder(tokenizer))
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), strings(batch.column(1))):
                ids = np.array([*encoder.ids(text), end_id], dtype="<u4")
                data = memoryview(ids).cast("B")
                for number, (start, size) in enumerate(cut(len(ids), capacity)):
                    crc = zlib.crc32(data[4 * start : 4 * (start + size)])
                    row = (doc, number, start, size, crc)
                    rows.append((*row, ids[start : start + size].tolist()) if with_ids else row)
            columns = list(zip(*rows)) if rows else [[] for _ in names]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=k) for c, k in zip(columns, kinds)], names=names
            )

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(pieces, PIECES + ", ids array<long>" * with_ids)


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = 1024,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """All documents in as few sequences of at most ``capacity`` tokens as best fit finds.

    Nulls, empty texts, repeated rows and empty tables: as in ``token_pieces``; columns other than the
    two named are not read. Ties between equal lengths go by task and row, so the same files give the
    same sequences.
    """
    pieces = token_pieces(docs, tokenizer, capacity, end_id, id_col, text_col, with_ids)
    return place(pieces, capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, from ``pack_documents(…, with_ids=True)``.

    A sequence is bounded by the capacity, so gathering its pieces in one row is too.
    """
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id",
        F.flatten(F.col("parts.ids")).alias("ids"),
        F.col("parts.doc_id").alias("doc_ids"),
        F.col("parts.offset").alias("offsets"),
    )
