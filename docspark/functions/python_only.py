"""Functions that no built-in expression can give: tolerant HTML and JSON.

All run batch by batch over Arrow, and none raises: a value that cannot be read has a defined result.
"""

from __future__ import annotations

import json
import re
from html import unescape

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0"


_REST = r"""(?:[^<>"']|"[^"]*"|'[^']*')*>"""
_TAG = re.compile(rf"<[/!?a-z]{_REST}", re.I)
# a cell: an opening tag and the text up to the tag that closes it; a closing tag alone is an empty cell
_CELL = re.compile(rf"(?:<t[dh]\b{_REST}((?:(?!</?t[dh]\b).)*))?</t[dh]\b{_REST}", re.I | re.S)
_ROW_START, _ROW_END = re.compile(rf"<tr\b{_REST}", re.I), re.compile(r"</tr\s*>", re.I)
_TABLE = re.compile(rf"<table\b{_REST}", re.I)


def _without_comments(source: str) -> str:
    """``source`` without its closed comments, in one pass: what is never closed is looked for once."""
    kept, at = [], 0
    while (start := source.find("<!--", at)) >= 0 and (end := source.find("-->", start + 4)) >= 0:
        kept.append(source[at:start])
        at = end + 3
    return "".join([*kept, source[at:]])


def _cells(row: str) -> list[str]:
    """The texts of a row's cells: tags taken out, character references resolved."""
    return [unescape(_TAG.sub("", m[1] or "")).strip() for m in _CELL.finditer(row)]


def table_to_markdown(html: str | None) -> str:
    """A Markdown table of the rows of ``html``; empty without a table tag or a row with cells.

    A row ends at its closing tag and begins after the last opening one before that.
    """
    source = _without_comments(html or "")
    if not _TABLE.search(source):
        return ""
    ended = _ROW_END.split(source)[:-1]
    rows = [cells for part in ended if (cells := _cells(_ROW_START.split(part)[-1]))]
    if not rows:
        return ""
    line = lambda cells: f"| {' | '.join(cells)} |"
    shown = [line(c.replace("|", "\\|").replace("\n", " ").strip() for c in cells) for cells in rows]
    return "\n".join([shown[0], line(["---"] * len(rows[0])), *shown[1:]])


_FENCE = re.compile(r"\A\s*(?:```[^\n]*\n)?(.*?)(?:\n[ \t]*```[^\n]*\s*)?\Z", re.S)
_DECODER = json.JSONDecoder()


def _readings(answer: str):
    """What an answer can be read as: JSON by itself, inside a fence, or from its first brace on."""
    for text in (answer, _FENCE.match(answer)[1]):
        yield lambda text=text: json.loads(text.strip())
    if "{" in answer:
        yield lambda: _DECODER.raw_decode(answer, answer.index("{"))[0]


def tolerant_json(answer: str | None) -> str:
    """The JSON in a model's answer (thinking spans taken out before), or {"description": answer}."""
    answer = answer or ""
    for read in _readings(answer):
        try:
            return json.dumps(read())
        except (ValueError, RecursionError):
            continue
    return json.dumps({"description": answer})


def description(answer: str | None) -> str:
    """The description in a model's answer; empty where it has an error, or is no object."""
    value = json.loads(tolerant_json(answer))
    if not isinstance(value, dict) or "error" in value:
        return ""
    return str(value.get("description", "")).strip()


def _mapped(function):
    @F.pandas_udf(StringType())
    def column(values: pd.Series) -> pd.Series:
        return values.map(function, na_action=None)

    return column


table_markdown = _mapped(lambda v: table_to_markdown(v if isinstance(v, str) else None))
robust_json = _mapped(lambda v: tolerant_json(v if isinstance(v, str) else None))
answer_description = _mapped(lambda v: description(v if isinstance(v, str) else None))
dumped_json = _mapped(lambda v: json.dumps(json.loads(v)) if isinstance(v, str) else "[]")


@F.pandas_udf(ArrayType(StringType()))
def tables_markdown(bodies: pd.Series) -> pd.Series:
    """The tables of a document's bodies, null where there is no body, or no array."""
    return bodies.map(lambda of: None if of is None else [None if b is None else table_to_markdown(b) for b in of])
