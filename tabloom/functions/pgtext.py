"""Text forms of the artifacts: array literals, typed values, cells of a bulk load."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

#: Fixed value: how null is written in a bulk load.
NULL_MARKER = "NULL_MARKER"


def parse_array(text: str | None) -> list[str | None] | None:
    r"""Items of {a,"b \"c\"",d}: a comma separates, quotes keep what they hold, a backslash keeps the next character;
    an unquoted NULL is null. Null and blank: null."""
    if text is None or not text.strip():
        return None
    body = text.strip().removeprefix("{").removesuffix("}")
    if not body:
        return []
    out, part, quoted, was, i = [], [], False, False, 0

    def item():
        word = "".join(part)
        return None if not was and word == "NULL" else word

    while i < len(body):
        c = body[i]
        if c == "\\" and i + 1 < len(body):
            i += 1
            part.append(body[i])
        elif c == '"':
            quoted, was = not quoted, True
        elif c == "," and not quoted:
            out.append(item())
            part, was = [], False
        else:
            part.append(c)
        i += 1
    return [*out, item()]


def render_array(items: list | None) -> str | None:
    """The inverse of parse_array."""
    if items is None:
        return None
    cell = lambda x: "NULL" if x is None else x if re.fullmatch(r'[^\s,"\\{}]+', x) and x != "NULL" else '"' + x.replace("\\", "\\\\").replace('"', '\\"') + '"'
    return "{" + ",".join(cell(x) for x in items) + "}"


def plain_array(text: Column) -> Column:
    """Items of an array literal without quotes and escapes."""
    body = F.regexp_replace(F.trim(text), r"^\{|\}$", "")
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, ","))


def frequencies(text: Column) -> Column:
    return F.transform(plain_array(text), lambda x: F.trim(x).cast("double"))


def typed(text: str, kind: str) -> str:
    """SQL that parses a text as a type, and is the text itself where that fails; both as text."""
    return f"coalesce(cast(try_cast({text} as {kind}) as string), {text})"


def cell(value: Column, is_array: bool = False) -> Column:
    """A cell of a bulk load: the marker for null, {..} with one element for arrays."""
    own = F.concat(F.lit("{"), value.cast("string"), F.lit("}")) if is_array else value.cast("string")
    return F.coalesce(own, F.lit(NULL_MARKER))


def error_line(message: Column) -> Column:
    """The number after the word line in an error message; -1 without."""
    return F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(message, r"line\s+(\d+)", 1), F.lit("")), F.lit("999999999")).cast("int"), F.lit(-1))
