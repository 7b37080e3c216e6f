"""Block segmentation of Markdown into prose spans with their heading path.

A block parser for what the spans need: ATX and setext headings, fenced and
indented code, block quotes, tables, HTML blocks, metadata between rules, lists
and paragraphs.  Spans are paragraphs and list items outside all the others;
their text is the raw slice of the source without white space at its end.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

MAX_LINE_BYTES = 65_536
ATX = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
SETEXT = re.compile(r"^ {0,3}(=+|-+)[ \t]*$")
FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})")
ITEM = re.compile(r"^( {0,3})([-+*]|\d{1,9}[.)])([ \t]+|$)")
RULE = re.compile(r"^ {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
HTML = re.compile(r"^ {0,3}<(?:[A-Za-z/!?])")
TABLE_RULE = re.compile(r"^ {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
SPAN = "text string, line_start int, line_end int, char_start long, char_end long, heading_path array<string>"


def segments(source: str) -> list[dict]:
    lines, offset, rows = source.split("\n"), 0, []
    for k, raw in enumerate(lines):
        size = len(raw.encode()) + 1
        text = raw.removesuffix("\r")
        rows.append((k + 1, offset, " " * len(text) if len(text.encode()) > MAX_LINE_BYTES else text))
        offset += size
    headings: list[tuple[int, str]] = []
    spans: list[dict] = []
    raw_bytes = source.encode()

    def emit(first: int, last: int, indent: int = 0) -> None:
        start = rows[first][1] + indent
        end = rows[last][1] + len(rows[last][2].encode())
        kept = raw_bytes[start:end].rstrip(b"\n\r \t")
        if kept:
            text = kept.decode()
            spans.append({"text": text, "line_start": rows[first][0], "line_end": rows[first][0] + text.count("\n"), "char_start": start, "char_end": start + len(kept), "heading_path": [h for _, h in headings]})

    def heading(level: int, text: str) -> None:
        while headings and headings[-1][0] >= level:
            headings.pop()
        headings.append((level, text.strip()))

    i, n = 0, len(rows)
    for mark in ("---", "+++"):
        if n and rows[0][2].rstrip() == mark:
            close = next((k for k in range(1, n) if rows[k][2].rstrip() == mark), None)
            if close:
                i = close + 1
    while i < n:
        text = rows[i][2]
        if not text.strip():
            i += 1
        elif m := FENCE.match(text):
            close = re.compile(rf"^ {{0,3}}{re.escape(m[1][0])}{{{len(m[1])},}}[ \t]*$")
            i = next((k for k in range(i + 1, n) if close.match(rows[k][2])), n) + 1
        elif m := ATX.match(text):
            heading(len(m[1]), m[2] or "")
            i += 1
        elif RULE.match(text):
            i += 1
        elif text.startswith("    ") or text.startswith("\t"):
            i += 1
        elif text.lstrip().startswith(">"):
            while i < n and rows[i][2].strip():
                i += 1
        elif HTML.match(text):
            while i < n and rows[i][2].strip():
                i += 1
        elif m := ITEM.match(text):
            i = _items(rows, i, n, emit)
        elif i + 1 < n and "|" in text and "|" in rows[i + 1][2] and TABLE_RULE.match(rows[i + 1][2]):
            while i < n and rows[i][2].strip():
                i += 1
        else:
            last, title = i, False
            while last + 1 < n and rows[last + 1][2].strip():
                following = rows[last + 1][2]
                if m := SETEXT.match(following):
                    heading(1 if m[1][0] == "=" else 2, "\n".join(rows[k][2] for k in range(i, last + 1)))
                    title = True
                    break
                if ATX.match(following) or FENCE.match(following) or RULE.match(following) or ITEM.match(following) or following.lstrip().startswith(">"):
                    break
                last += 1
            if title:
                i = last + 2
            else:
                emit(i, last, len(text) - len(text.lstrip(" ")))
                i = last + 1
    return spans


def _items(rows: list[tuple[int, int, str]], i: int, n: int, emit) -> int:
    """Items of one list from line ``i``: each its outer range; a further paragraph in an item is a span of its own."""
    base = len(ITEM.match(rows[i][2])[1])
    while i < n:
        m = ITEM.match(rows[i][2])
        if not m or len(m[1]) < base or RULE.match(rows[i][2]):
            break
        inner = len(m[0])
        last, blank, paragraphs = i, False, []
        k = i + 1
        while k < n:
            line = rows[k][2]
            depth = len(line) - len(line.lstrip(" "))
            if not line.strip():
                blank = True
            elif depth >= inner or (not blank and not ITEM.match(line) and not ATX.match(line) and not FENCE.match(line)):
                if blank and not ITEM.match(line.lstrip(" ")):
                    paragraphs.append(k)
                blank, last = False, k
            else:
                break
            k += 1
        emit(i, last, len(m[1]))
        for p in paragraphs:
            end = p
            while end + 1 <= last and rows[end + 1][2].strip():
                end += 1
            emit(p, end, len(rows[p][2]) - len(rows[p][2].lstrip(" ")))
        i = k
        if i < n and not ITEM.match(rows[i][2]):
            break
    return i


def segment_candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a row per prose span.  Rows are parsed one by one; nothing is shuffled."""
    others = [f for f in docs.schema if f.name != text]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in others] + [SPAN])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for row in part.to_dict("records"):
                body = row.pop(text)
                out += [{**row, **s} for s in segments(body or "")]
            yield pd.DataFrame(out, columns=[f.name for f in others] + ["text", "line_start", "line_end", "char_start", "char_end", "heading_path"])

    return docs.mapInPandas(run, schema)
