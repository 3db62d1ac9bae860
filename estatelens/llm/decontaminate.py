"""Benchmark decontamination with a generalised suffix automaton over test items.

A word is a run of digits, letters and signs beyond ASCII, with A-Z in lower case; items and texts are
compared as sequences of words. A *window* is ``window`` consecutive words of an item; an item of fewer
words, but not none, is one window as a whole. A document word is *hit* if it lies in an occurrence of a
window.

* The items' words make one suffix automaton. A state stands for all word sequences that end at the same
  places of the items; its link leads to the longest suffix that ends at more places.
* A text is streamed through it word by word. The state and a length are the longest match that ends at
  the word; a miss follows links until a shorter match goes on, so a word costs constant time on average
  and nothing of the text is kept. Whatever is found at a word follows from state and length: the window
  that ends there, the items that have it, and the whole short items that end there.
* Found windows are joined to spans, each with its longest match. ``decontaminate`` cuts spans out whose
  match is long enough, and drops documents that such spans cover too much of.

Items are dealt over blocks of at most about ``block_words`` words (long items in pieces that overlap by a
window less one word), each block is one automaton, built in a task of its own and a bounded broadcast.
One block is scanned in one pass over the texts without any shuffle. More blocks are one pass each, of
which only texts with finds leave a row, under a digest of the text, since finds depend on the text alone.
"""

from __future__ import annotations

import pickle
import re
from collections import defaultdict
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from estatelens.llm.workers import free, slices, utf8
from estatelens.operators.skew import spread_join
from estatelens.session import durable

WINDOW = 10
#: Words of one automaton, about; it takes some 300 bytes a word in a worker.
BLOCK_WORDS = 200_000
#: Words of one piece of a long item, before the overlap.
PIECE_WORDS = 5_000
#: Bytes of a huge text that are cut into words at a time.
STRETCH = 1 << 20

_WORD_BYTES = set(b"0123456789abcdefghijklmnopqrstuvwxyz") | set(range(0x80, 0x100))
_FLAT = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b in _WORD_BYTES else 0x20 for b in range(256)
)
_WORD = re.compile(rb"[^ ]+")
_WORD_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

SPANS = "array<struct<first: bigint, end: bigint, longest: bigint, whole: boolean>>"
MATCHES = f"struct<n_words: bigint, items: array<string>, spans: {SPANS}>"


@dataclass(frozen=True)
class Limits:
    """What ``decontaminate`` removes.

    A span goes if its longest match has ``length`` words or it holds a whole short item; a document goes
    if such spans cover more than ``coverage_percent`` of its words.
    """

    length: int = WINDOW
    coverage_percent: int = 50


def _stretches(raw: bytes):
    """The words of a text, in lists of bounded size."""
    flat = raw.translate(_FLAT)
    at = 0
    while at < len(flat):
        end = at + STRETCH
        if end < len(flat):
            end = flat.find(b" ", end)
        if end < 0 or end >= len(flat):
            end = len(flat)
        yield flat[at:end].split()
        at = end


# --- the automaton ------------------------------------------------------------------------------------


class _Builder:
    """Suffix automaton of several word sequences."""

    def __init__(self):
        self.moves, self.link, self.length = [{}], [-1], [0]

    def _state(self, moves: dict, link: int, length: int) -> int:
        self.moves.append(moves)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        """A state for the sequences of ``q`` that are not longer than those through ``p``."""
        clone = self._state(dict(self.moves[q]), self.link[q], self.length[p] + 1)
        self.link[q] = clone
        while p >= 0 and self.moves[p].get(word) == q:
            self.moves[p][word] = clone
            p = self.link[p]
        return clone

    def extend(self, last: int, word: int) -> int:
        """The state of the sequence of ``last`` with one more word."""
        q = self.moves[last].get(word)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, word, q)
        new = self._state({}, 0, self.length[last] + 1)
        p = last
        while p >= 0 and word not in self.moves[p]:
            self.moves[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.moves[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
        return new


def automaton(pieces: list[tuple[str | None, bool, list[bytes]]], window: int) -> tuple:
    """The automaton of (item, is it a whole short item, words) as plain lists and dicts.

    (codes, moves, link, length, need, windows, shorts, next_short): ``codes`` are numbers of words times
    the number of states, so that ``code + state`` finds a move. ``need`` is the match length from which
    on a state finds something. ``windows`` and ``shorts`` list items by state: those of the state's suffix
    of ``window`` words, and those that are this state's longest sequence as a whole.
    """
    numbers: dict[bytes, int] = {}
    build = _Builder()
    for _, _, words in pieces:
        last = 0
        for word in words:
            last = build.extend(last, numbers.setdefault(word, len(numbers)))
    link, length = build.link, build.length
    size = len(link)
    by_length = sorted(range(1, size), key=length.__getitem__)
    window_state = [-1] * size
    for v in by_length:
        if length[v] >= window:
            window_state[v] = v if length[link[v]] < window else window_state[link[v]]
    at_window, at_short = defaultdict(set), defaultdict(set)
    for item, short, words in pieces:
        v = 0
        for n, word in enumerate(words, 1):
            v = build.moves[v][numbers[word]]
            if n >= window:
                at_window[window_state[v]].add(item)
        if short:
            at_short[v].add(item)
    never = 1 << 60
    need, next_short = [never] * size, [-1] * size
    for v in by_length:
        up = link[v]
        next_short[v] = up if up in at_short else next_short[up]
        if next_short[v] >= 0 or (up and window_state[up] >= 0):
            need[v] = 1
        else:
            if window_state[v] == v:
                need[v] = window
            if v in at_short:
                need[v] = min(need[v], length[v])
    named = [{v: sorted(i for i in found if i is not None) for v, found in at.items()} for at in (at_window, at_short)]
    windows = {v: (named[0][window_state[v]]) for v in range(size) if window_state[v] >= 0}
    moves = {code * size + v: to for v in range(size) for code, to in build.moves[v].items()}
    codes = {word: number * size for word, number in numbers.items()}
    return codes, moves, link, length, need, windows, named[1], next_short


class Scanner:
    """Streams texts through an automaton."""

    def __init__(self, parts: tuple, window: int):
        self.parts, self.window = parts, window

    def scan(self, raw: bytes) -> tuple[int, list[str], list[list]]:
        """(words, items found, spans [first word, end, longest match, holds a whole short item])."""
        codes, moves, link, length, need, windows, shorts, next_short = self.parts
        code_of, move = codes.get, moves.get
        v = matched = at = 0
        items: set[str] = set()
        seen: set[int] = set()
        spans: list[list] = []
        for words in _stretches(raw):
            for word in map(code_of, words):
                at += 1
                if word is None:
                    v = matched = 0
                    continue
                to = move(v + word)
                while to is None:
                    v = link[v]
                    matched = length[v]
                    to = move(v + word)
                v = to
                matched += 1
                if matched < need[v]:
                    continue
                reach, whole = 0, False
                state = v if v in shorts and matched == length[v] else next_short[v]
                if state >= 0:
                    reach, whole = length[state], True
                while state >= 0 and -state not in seen:
                    seen.add(-state)
                    items.update(shorts[state])
                    state = next_short[state]
                if matched >= self.window and v in windows:
                    reach = max(reach, self.window)
                    if v not in seen:
                        seen.add(v)
                        items.update(windows[v])
                first, longest = at - reach, matched
                while spans and spans[-1][1] >= first:
                    before = spans.pop()
                    first, longest = min(first, before[0]), max(longest, before[2])
                    whole = whole or before[3]
                spans.append([first, at, longest, whole])
        return at, sorted(items), spans


# --- blocks of items ------------------------------------------------------------------------------------


def _pieces(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(item, part, short, n, words) of all items with words, each distinct piece once."""

    def cut(batches):
        for batch in slices(batches, 1):
            rows = []
            for item, raw in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                words = raw.translate(_FLAT).split()
                for part, at in enumerate(range(0, max(len(words) - window + 1, min(len(words), 1)), PIECE_WORDS)):
                    piece = words[at : at + PIECE_WORDS + window - 1]
                    rows.append((item, part, len(words) < window, len(piece), b" ".join(piece).decode()))
            names = ["item", "part", "short", "n", "words"]
            columns = list(zip(*rows)) or [[]] * 5
            types = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    slim = items.select(F.col(f"`{id_col}`").cast("string").alias("item"), F.col(f"`{text_col}`").cast("string").alias("words"))
    return slim.mapInArrow(cut, "item string, part long, short boolean, n long, words string").distinct()


def automata(
    items: DataFrame, window: int, id_col: str, text_col: str, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """(block, automaton) of all items, one row per block, written to the shared folder."""
    pieces = durable(_pieces(items, id_col, text_col, window))
    total = pieces.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    blocks = 1 + 2 * total // block_words

    def build(table: pa.Table) -> pa.Table:
        columns = [table.column(c).to_pylist() for c in ("item", "short", "words")]
        rows = sorted(zip(*columns), key=lambda r: (r[2], r[1], r[0] is None, r[0] or ""))
        made = automaton([(i, s, w.encode().split()) for i, s, w in rows], window)
        block = table.column("block")[0].as_py()
        return pa.table({"block": pa.array([block], pa.int32()), "automaton": pa.array([pickle.dumps(made, 5)], pa.binary())})

    block = F.pmod(F.xxhash64("item", "part", "words"), F.lit(blocks)).cast("int")
    dealt = pieces.withColumn("block", block).select("block", "item", "short", "words")
    return durable(dealt.groupBy("block").applyInArrow(build, "block int, automaton binary"))


def _matches(
    docs: DataFrame, text_col: str, made: DataFrame, window: int, out: str
) -> DataFrame:
    """``docs`` with one more column ``out`` of the type ``MATCHES``; null texts have no words."""
    context = docs.sparkSession.sparkContext
    blocks = sorted(r["block"] for r in made.select("block").collect())

    def scanner(block: int):
        shared = context.broadcast(bytes(made.where(F.col("block") == block).first()["automaton"]))
        return lambda: Scanner(pickle.loads(shared.value), window)

    def struct(rows: list) -> pa.Array:
        span = pa.struct([("first", pa.int64()), ("end", pa.int64()), ("longest", pa.int64()), ("whole", pa.bool_())])
        kind = pa.struct([("n_words", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(span))])
        keys = ("first", "end", "longest", "whole")
        return pa.array([{"n_words": n, "items": i, "spans": [dict(zip(keys, s)) for s in spans]} for n, i, spans in rows], kind)

    if len(blocks) <= 1:
        make = scanner(blocks[0]) if blocks else (lambda: Scanner(automaton([], window), window))
        at = docs.columns.index(text_col)

        def scan(batches):
            found = make()
            for batch in slices(batches, at):
                added = struct([found.scan(raw) for raw in utf8(batch.column(at))])
                yield pa.RecordBatch.from_arrays([*batch.columns, added], [*batch.schema.names, out])

        return docs.mapInArrow(scan, T.StructType([*docs.schema.fields, T.StructField(out, T.DataType.fromDDL(MATCHES))]))

    slim = docs.select(F.sha2(F.col(f"`{text_col}`"), 256).alias("digest"), F.col(f"`{text_col}`").alias("text"))

    def one_pass(block: int) -> DataFrame:
        make = scanner(block)

        def scan(batches):
            found = make()
            for batch in slices(batches, 1):
                scanned = [found.scan(raw) for raw in utf8(batch.column(1))]
                hit = [i for i, row in enumerate(scanned) if row[2]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(hit, pa.int64())), struct([scanned[i] for i in hit])], ["digest", "found"]
                )

        rows = slim.where("text IS NOT NULL").mapInArrow(scan, f"digest string, found {MATCHES}")
        return durable(rows.dropDuplicates(["digest"]))

    passes = [one_pass(block) for block in blocks]
    every = passes[0]
    for more in passes[1:]:
        every = every.unionAll(more)
    # at most one row per block and text
    by_text = every.groupBy("digest").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("found.items")))).alias("items"),
        F.array_sort(F.flatten(F.collect_list("found.spans"))).alias("spans"),
    )
    key, items, spans = (free(n, docs) for n in ("text_digest", "found_items", "found_spans"))
    by_text = durable(by_text.withColumnsRenamed({"digest": key, "items": items, "spans": spans}))
    joined = spread_join(docs.withColumn(key, F.sha2(F.col(f"`{text_col}`"), 256)), by_text, [key], "left")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    struct_of = F.struct(
        F.regexp_count(text, F.lit(_WORD_PATTERN)).cast("long").alias("n_words"),
        F.coalesce(F.col(items), F.array().cast("array<string>")).alias("items"),
        F.coalesce(_joined(F.col(spans)), F.array().cast(SPANS)).alias("spans"),
    )
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], struct_of.alias(out))


def _joined(spans):
    """Sorted spans with those that touch joined, as a running fold."""
    return F.aggregate(
        spans,
        F.array().cast(SPANS),
        lambda done, s: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["end"] >= s["first"]),
            F.concat(
                F.slice(done, F.lit(1), F.size(done) - 1),
                F.array(
                    F.struct(
                        F.element_at(done, -1)["first"].alias("first"),
                        F.greatest(F.element_at(done, -1)["end"], s["end"]).alias("end"),
                        F.greatest(F.element_at(done, -1)["longest"], s["longest"]).alias("longest"),
                        (F.element_at(done, -1)["whole"] | s["whole"]).alias("whole"),
                    )
                ),
            ),
        ).otherwise(F.concat(done, F.array(s))),
    )


# --- the operator ---------------------------------------------------------------------------------------


def find_contamination(
    docs: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, longest, items (ids as sorted strings), spans.

    ``spans`` are word places (first, end exclusive) with their longest match in words. Null and empty texts
    have no words and no hits; texts of any length are streamed. Repeated rows, also of one id, are each
    judged by their own text. Items without words and an empty item table hit nothing; repeated items count
    once by id, and an item without an id hits words but is not listed. An empty table stays empty. Further
    columns of either table, of any name, are not looked at.
    """
    slim = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    made = automata(items, window, item_id_col, item_text_col, block_words)
    found = _matches(slim, "text", made, window, "found")
    spans = F.col("found.spans")
    return found.select(
        "doc_id",
        F.col("found.n_words").alias("n_words"),
        F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"]).alias("n_hit"),
        F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: F.greatest(n, s["longest"])).alias("longest"),
        F.col("found.items").alias("items"),
        spans.alias("spans"),
    )


def cut(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    """A text without the words ``spans``, with what stands between the words of a span."""
    edges = [edge for span in spans for edge in span]
    kept, at, place = [], 0, 0
    for number, word in enumerate(_WORD.finditer(raw.translate(_FLAT))):
        if place % 2 == 0 and place < len(edges) and number == edges[place]:
            kept.append(raw[at : word.start()])
            place += 1
        if place % 2 == 1 and number == edges[place] - 1:
            at = word.end()
            place += 1
    return b"".join([*kept, raw[at:]])


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    limits: Limits = Limits(),
    window: int = WINDOW,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """``docs`` without spans, and without documents, beyond ``limits``; columns stay as they are.

    Texts without such a span, null ones among them, stay as they are, byte for byte; a text that is cut
    keeps everything outside its spans. Repeated rows are treated alike; an empty table stays empty.
    """
    found = free("found", docs)
    made = automata(items, window, item_id_col, item_text_col, block_words)
    matched = _matches(docs, text_col, made, window, found)
    at, last = docs.columns.index(text_col), len(docs.columns)

    def clean(batches):
        for batch in slices(batches, at):
            keep, texts = [], []
            for i, (text, match) in enumerate(zip(batch.column(at).to_pylist(), batch.column(last).to_pylist())):
                bad = [(s["first"], s["end"]) for s in match["spans"] if s["longest"] >= limits.length or s["whole"]]
                if 100 * sum(end - first for first, end in bad) > limits.coverage_percent * match["n_words"]:
                    continue
                keep.append(i)
                texts.append(cut(text.encode(), bad).decode() if bad else text)
            left = batch.take(pa.array(keep, pa.int64()))
            columns = left.columns[:last]
            columns[at] = pa.array(texts, batch.column(at).type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:last])

    return matched.mapInArrow(clean, docs.schema)
