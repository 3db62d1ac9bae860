"""Removal of storage clauses, the one text operation that needs balanced parentheses.

Balanced parentheses are beyond a regular expression, so this is an Arrow UDF. Only texts that can
hold such a clause are sent to it; all others stay in the JVM.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from estatelens import fixed_values as V

RESULT = StructType([StructField("text", StringType()), StructField("removed", LongType())])
_ARROW_RESULT = pa.struct([("text", pa.string()), ("removed", pa.int64())])


def strip_one(text: str) -> tuple[str, int]:
    """``text`` without its storage clauses, and how many there were.

    A clause is ``WITH ( … )`` up to the matching parenthesis (or the end of the text) with a storage
    word inside. Words and parentheses are found in one pass each, so the work is linear in the text.
    """
    words = list(re.finditer(V.STORAGE_WORD, text, re.I))
    starts = [word.start() for word in words]
    closing: dict[int, int] = {}
    waiting: list[int] = []
    for paren in re.finditer(r"[()]", text):
        if paren[0] == "(":
            waiting.append(paren.start())
        elif waiting:
            closing[waiting.pop()] = paren.start()
    kept: list[str] = []
    done = removed = 0
    for clause in re.finditer(V.WITH_OPEN, text, re.I):
        if clause.start() < done:
            continue  # inside a clause that is already gone
        end = closing.get(clause.end() - 1, len(text))
        first = bisect_left(starts, clause.end())
        if first < len(words) and words[first].end() <= end:
            kept.append(text[done : clause.start()])
            done = end + 1
            removed += 1
    kept.append(text[done:])
    return "".join(kept), removed


@F.arrow_udf(RESULT)
def _strip_clauses(texts: pa.Array) -> pa.Array:
    results = [strip_one(t.as_py()) if t.is_valid else None for t in texts]
    return pa.array(
        [None if r is None else {"text": r[0], "removed": r[1]} for r in results],
        type=_ARROW_RESULT,
    )


def strip_storage_clauses(c: Column) -> Column:
    """Struct of the cleaned text and the number of clauses; null where there is none to remove."""
    opened = F.rlike(c, F.lit(f"(?iU){V.WITH_OPEN}"))
    stored = F.rlike(c, F.lit(f"(?iU){V.STORAGE_WORD}"))
    return _strip_clauses(F.when(opened & stored, c))
