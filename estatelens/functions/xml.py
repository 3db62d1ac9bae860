"""Package XML as Spark columns, by patterns: a malformed file gives what can be found, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# inside a start tag: plain characters or quoted attribute values (which may hold '>')
_TAG_BODY = r"""(?:[^>"']+|"[^"]*+"|'[^']*+')*+"""
# named references in the order they are undone; the ampersand comes last
_NAMED = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")]
# a numbered reference and the text up to the next one
_NUMBERED = r"&#(?:x0*+[0-9A-Fa-f]{1,6}|0*+[0-9]{1,7});"


def unescape(c: Column) -> Column:
    """Character references, named, decimal and hexadecimal, back to characters."""
    plain = c
    for reference, character in _NAMED:
        plain = F.replace(plain, F.lit(reference), F.lit(character))
    return F.when(F.contains(c, F.lit("&#")), _with_numbered(c)).when(F.contains(c, F.lit("&")), plain).otherwise(c)


def _with_numbered(c: Column) -> Column:
    """The text is cut before every reference; each piece is its reference's character and what follows.

    Numbers that are no character stay as they are written.
    """

    def piece(p: Column) -> Column:
        written = F.regexp_extract(p, rf"^{_NUMBERED}", 0)
        hexadecimal = F.substring(written, 3, 1) == "x"
        number = F.when(
            hexadecimal, F.conv(F.regexp_extract(written, "x([0-9A-Fa-f]+)", 1), 16, 10).cast("int")
        ).otherwise(F.regexp_extract(written, "([0-9]+)", 1).try_cast("int"))
        valid = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
        # a character is its four bytes in UTF-32
        character = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
        rest = F.substring(p, F.length(written) + 1, F.lit(2**31 - 1))
        for reference, named in _NAMED:
            rest = F.replace(rest, F.lit(reference), F.lit(named))
        return F.concat(F.when(valid, character).otherwise(written), rest)

    return F.array_join(F.transform(F.split(c, rf"(?={_NUMBERED})", -1), piece), "")


def start_tags(c: Column, element: str) -> Column:
    """All start tags of an element, as text."""
    return F.regexp_extract_all(c, F.lit(rf"<{element}\b{_TAG_BODY}>"), F.lit(0))


def attribute(tag: Column, name: str) -> Column:
    """An attribute's value out of a tag's text, null if it is not there."""
    value = F.regexp_extract(tag, rf'[\s]{name}="([^"]*+)"', 1)
    present = F.rlike(tag, F.lit(rf'[\s]{name}="'))
    return F.when(present, unescape(value))


def nodes(c: Column) -> Column:
    """The text cut before every task and component, the part before the first one left out."""
    parts = F.split(c, r"(?=<(?:DTS:Executable|component)[\s>/])")
    return F.filter(parts, lambda p: F.rlike(p, F.lit(r"^<(?:DTS:Executable|component)[\s>/]")))
