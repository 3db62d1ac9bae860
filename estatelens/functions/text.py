"""Script text as Spark columns: batches, statements, kinds, names and sizes.

All of it is regular expressions and array functions inside the JVM. Repeated groups are possessive,
so a text of many megabytes neither backtracks nor deepens the stack.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from estatelens import fixed_values as V


def strip(c: Column) -> Column:
    """White space (as Python sees it) off both ends, in linear time."""
    return F.btrim(c, F.lit(V.WHITE_SPACE))


def is_blank(c: Column) -> Column:
    return strip(c) == ""


def decode(content: Column) -> Column:
    """Bytes to text: bad UTF-8 becomes U+FFFD, line ends become ``\\n``."""
    return F.regexp_replace(decode_bytes(content), r"\r\n?", "\n")


def decode_bytes(content: Column) -> Column:
    """Bytes to text: bad UTF-8 becomes U+FFFD, line ends stay."""
    return F.make_valid_utf8(content.cast("string"))


def up_to_last(c: Column, mark: str) -> tuple[Column, Column]:
    """The text up to the last ``mark`` (a pattern), and the rest.

    A pattern that has to end in the mark is run on the first part only. In the rest it could only
    search on to the end of the text in vain, once per place it might begin.
    """
    head = F.regexp_extract(c, rf"(?s)^.*(?:{mark})", 0)
    return head, F.substring(c, F.length(head) + 1, F.lit(2**31 - 1))


def strip_comments(c: Column) -> Column:
    """Block comments out first, then line comments; quotes are not looked at."""
    head, rest = up_to_last(c, r"\*/")
    bare = F.concat(F.regexp_replace(head, V.BLOCK_COMMENT, ""), rest)
    blockless = F.when(c.contains("/*"), bare).otherwise(c)
    return F.when(c.contains("--") | c.contains("/*"), F.regexp_replace(blockless, V.LINE_COMMENT, "")).otherwise(c)


# -- batches and statements


def batches(c: Column) -> Column:
    """Text between lines that hold only ``GO``."""
    return F.split(c, V.BATCH_LINE)


def is_batch_line(line: Column) -> Column:
    """Does this one line only hold ``GO``?"""
    return F.rlike(line, F.lit(V.BATCH_LINE))


# comments that hold others up to this deep are found by one pattern
_PATTERN_DEPTH = 64


def _nested_comment(depth: int) -> str:
    """A closed comment that holds others, ``depth`` deep at most."""
    found = ""
    for _ in range(depth):
        found = rf"/\*(?:[^*/]+|\*(?!/)|/(?!\*){found and '|' + found})*+\*/"
    return found


def _between(comment: str) -> str:
    """What may stand between two separating semicolons, for a possessive group: nothing in it is tried again."""
    return "|".join(
        [
            r"'(?:[^']+|'')*+'",
            r'"(?:[^"]+|"")*+"',
            r"--[^\n]*",
            comment,
            r"""[^;'"/\-]+""",
            r"/(?!\*)",
            r"-(?!-)",
        ]
    )


# where no comment holds another one; a comment left open runs to the end
_FLAT_COMMENT = r"/\*(?:[^*/]+|\*(?!/)|/)*+(?:\*/)?"
# a quote that opens nothing matches alone and so marks an unbalanced text
_PIECE = rf"""(?:{_between(_FLAT_COMMENT)})++|['"]"""
# the same where comments are nested: a comment left open or nested deeper than the pattern goes takes the
# rest of the text and leaves the group empty, which no other piece does
_NESTED_PIECE = rf"""((?:{_between(_nested_comment(_PATTERN_DEPTH))})++|['"])|/\*[\s\S]*+"""
# an opening mark between another one and the next closing mark: comments may be nested
_NESTED = r"/\*(?:[^*/]++|\*(?!/)|/(?!\*))*+/\*"
# all that can change what a semicolon means; signs of comment marks that touch are taken together
_MARK = r"""(?:\*/)++\*?|(?:/\*)++/?|--|[;'"\n]"""
# what stands around a mark: nothing, a quote, a double quote, a line comment; above 0 the comment depth
_PLAIN, _QUOTE, _DOUBLE, _LINE = 0, -1, -2, -3
_MARKS_AT_ONCE = 1000


def split_semicolons(batch: Column) -> Column:
    """Pieces between semicolons that are in no quote and no comment; comments may be nested at any depth.

    If a quote is left open every semicolon separates. Nested comments go by a pattern as deep as it
    reaches; a text with a deeper one, or with one left open, goes mark by mark.
    """

    def flat(pieces: Column) -> Column:
        open_quote = F.array_contains(pieces, "'") | F.array_contains(pieces, '"')
        return F.when(open_quote, F.split(batch, ";")).otherwise(pieces)

    def nested(pieces: Column) -> Column:
        return F.when(F.array_contains(pieces, ""), _split_nested(batch)).otherwise(flat(pieces))

    found = F.when(
        F.rlike(batch, F.lit(_NESTED)),
        _bound(F.regexp_extract_all(batch, F.lit(_NESTED_PIECE), F.lit(1)), nested),
    ).otherwise(_bound(F.regexp_extract_all(batch, F.lit(_PIECE), F.lit(0)), flat))
    return F.filter(found, lambda p: ~is_blank(p))


def _after(state: Column, mark: Column) -> Column:
    """The state behind a mark.

    Marks that touch, ``*/*/…``, close comments pair by pair; with none left open, the next star is a
    plain sign, and the pairs that follow it open comments again.
    """
    pairs = F.floor(F.length(mark) / 2).cast("int")
    left = F.length(mark) - 2 * state
    closed = F.when(pairs <= state, state - pairs).when(left > 0, F.floor((left - 1) / 2).cast("int")).otherwise(0)
    return (
        F.when(mark == ";", state)
        .when(mark == "\n", F.when(state == _LINE, _PLAIN).otherwise(state))
        .when(mark == "'", F.when(state == _PLAIN, _QUOTE).when(state == _QUOTE, _PLAIN).otherwise(state))
        .when(mark == '"', F.when(state == _PLAIN, _DOUBLE).when(state == _DOUBLE, _PLAIN).otherwise(state))
        .when(mark == "--", F.when(state == _PLAIN, _LINE).otherwise(state))
        .when(state < 0, state)
        .when(mark.startswith("/"), state + pairs)
        .otherwise(closed)
    )


def _split_nested(batch: Column) -> Column:
    """``split_semicolons`` by a depth counter that runs over the marks of a batch.

    The fold writes a 1 for each semicolon that separates and a 0 for any other. It goes by stretches of
    marks, so that what it has written so far is copied once a stretch instead of once a mark.
    """
    start = F.struct(F.lit(_PLAIN).alias("state"), F.lit("").alias("cuts"))

    def one(done: Column, mark: Column) -> Column:
        cut = F.when(mark != ";", "").when(done["state"] == _PLAIN, "1").otherwise("0")
        return F.struct(_after(done["state"], mark).alias("state"), F.concat(done["cuts"], cut).alias("cuts"))

    def stretch(marks: Column, done: Column, first: Column) -> Column:
        fresh = F.struct(done["state"].alias("state"), F.lit("").alias("cuts"))
        return F.aggregate(
            F.slice(marks, first, F.lit(_MARKS_AT_ONCE)),
            fresh,
            one,
            lambda made: F.struct(made["state"].alias("state"), F.concat(done["cuts"], made["cuts"]).alias("cuts")),
        )

    def fold(marks: Column) -> Column:
        firsts = F.sequence(F.lit(1), F.greatest(F.size(marks), F.lit(1)), F.lit(_MARKS_AT_ONCE))
        return F.aggregate(firsts, start, lambda done, first: stretch(marks, done, first))

    # NUL a stands for a NUL of the text and NUL b for a cut, so that no text can hold a cut by itself
    kept = F.split(F.replace(batch, F.lit("\x00"), F.lit("\x00a")), ";")

    def cut(cuts: Column) -> Column:
        joined = F.transform(
            kept, lambda piece, i: F.when(i == 0, piece).otherwise(
                F.concat(F.when(F.get(cuts, i - 1) == "1", "\x00b").otherwise(";"), piece)
            )
        )
        return F.transform(
            F.split(F.array_join(joined, ""), "\x00b"), lambda p: F.replace(p, F.lit("\x00a"), F.lit("\x00"))
        )

    def pieces(end: Column) -> Column:
        found = _bound(F.split(end["cuts"], ""), cut)
        return F.when(end["state"].isin(_QUOTE, _DOUBLE), F.split(batch, ";")).otherwise(found)

    return _bound(_bound(F.regexp_extract_all(batch, F.lit(_MARK), F.lit(0)), fold), pieces)


def _bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is made once, however often ``then`` and lambdas in it refer to it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def is_routine(batch: Column) -> Column:
    """Does the batch create a procedure, function or trigger?"""
    return F.rlike(strip_comments(batch), F.lit(V.ROUTINE))


def split_statements(c: Column) -> Column:
    """All statements of a script in order; a batch that creates a routine stays whole."""

    def statements(batch: Column) -> Column:
        return (
            F.when(is_blank(batch), F.array().cast("array<string>"))
            .when(is_routine(batch), F.array(batch))
            .otherwise(split_semicolons(batch))
        )

    return F.flatten(F.transform(batches(c), statements))


# -- one statement


def head_of(statement: Column, strict: bool = False) -> Column:
    """The statement's first characters after leading comments, upper case.

    ``strict`` gives its first five words instead, however long they are and whatever stands between them.
    """
    space = r"[\s\x1c-\x1f]"
    leading = rf"(?sU)^{space}*+(?:--[^\n]*\n|/\*.*?\*/{space}*)++"
    rest = F.ltrim(F.regexp_replace(statement, leading, ""), F.lit(V.WHITE_SPACE))
    if strict:
        between = rf"(?:{space}|--[^\n]*+\n|/\*[\s\S]*?\*/)++"
        words = F.regexp_extract(rest, rf"(?U)^(?:[^\s\x1c-\x1f]++{between}){{0,4}}+[^\s\x1c-\x1f]*+", 0)
        return F.upper(strip(F.regexp_replace(words, rf"(?U){between}", " ")))
    return F.upper(F.substring(rest, 1, V.CLASSIFY_WIDTH))


def statement_records(c: Column, strict: bool = False) -> Column:
    """The statements of a script, each with its text, its text without comments and its head.

    Making the three together, before the array is exploded, lets later steps use them as plain
    columns instead of running the patterns again for every reference.
    """
    return F.transform(
        split_statements(c),
        lambda s: F.struct(
            s.alias("statement"), strip_comments(s).alias("bare"), head_of(s, strict).alias("head")
        ),
    )


def kind_of(head: Column, strict: bool = False) -> Column:
    """The kind of a statement by its head.

    After CREATE the first listed word found anywhere in the head decides, so a view over a table
    named ``…Table`` can count as a table. ``strict`` looks at the word after CREATE [OR ALTER] only.
    """
    created = F.regexp_extract(head, r"^CREATE\s+(?:OR\s+ALTER\s+)?(\S+)", 1) if strict else head
    kind = F.when(F.lit(False), "")
    for word, name in V.CREATE_KINDS:
        found = created.startswith(word) if strict else created.contains(word)
        kind = kind.when(found, name)
    result = F.when(head.startswith("CREATE"), kind.otherwise(V.CREATE_OTHER))
    for verb in V.LEADING_VERBS:
        result = result.when(head.startswith(verb), verb)
    for verb in V.QUERY_VERBS:
        result = result.when(head.startswith(verb), "SELECT")
    token = F.regexp_extract(head, r"(?U)^[\s\x1c-\x1f]*([^\s\x1c-\x1f]+)", 1)
    return result.when(head == "", "OTHER").otherwise(token)


def classify(statement: Column, strict: bool = False) -> Column:
    """The kind of a statement by its text."""
    return kind_of(head_of(statement, strict), strict)


def name_in(bare: Column) -> Column:
    """The created object's name without brackets, null where nothing is created."""
    return F.nullif(F.translate(F.regexp_extract(bare, V.OBJECT_NAME, 1), "[]", ""), F.lit(""))


def object_name(statement: Column) -> Column:
    """``name_in`` of a statement that still has its comments."""
    return name_in(strip_comments(statement))


def line_count(c: Column) -> Column:
    return (F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))).cast("bigint") + 1


def size_of(bare: Column, statement: Column) -> Column:
    """Lexical size: words, numbers, quoted texts and signs outside comments.

    A statement without any falls back to its number of lines.
    """
    tokens = F.regexp_count(bare, F.lit(V.TOKEN)).cast("bigint")
    return F.when(is_blank(bare), line_count(statement)).otherwise(tokens)


def size_score(statement: Column) -> Column:
    """``size_of`` a statement that still has its comments."""
    return size_of(strip_comments(statement), statement)


def size_bucket(
    nodes: Column, low_max: int = V.OBJECT_LOW_MAX, medium_max: int = V.OBJECT_MEDIUM_MAX
) -> Column:
    """LOW / MEDIUM / HIGH by size."""
    return F.when(nodes <= low_max, "LOW").when(nodes <= medium_max, "MEDIUM").otherwise("HIGH")


def package_bucket(nodes: Column) -> Column:
    """LOW / MEDIUM / HIGH by a package's number of nodes."""
    return (
        F.when(nodes < V.PACKAGE_MEDIUM_MIN, "LOW")
        .when(nodes < V.PACKAGE_HIGH_MIN, "MEDIUM")
        .otherwise("HIGH")
    )


def function_calls(c: Column) -> Column:
    """Upper-case names before an opening parenthesis, outside comments and quoted texts."""
    bare = F.regexp_replace(strip_comments(c), r"'[^']*+'", "''")
    return F.transform(
        F.regexp_extract_all(bare, F.lit(V.FUNCTION_CALL), F.lit(1)), lambda name: F.upper(name)
    )
