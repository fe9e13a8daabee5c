"""Markdown reader: blocks, then inline text, into elements.

Blocks: ATX and setext headings, fenced and indented code, block quotes, bullet and
ordered lists (tight and loose, nested), thematic breaks, pipe tables, HTML blocks
(dropped), link reference definitions.  Inline: code spans, emphasis, strikethrough,
links, images (their description), autolinks, escapes, entities; breaks are spaces.
"""

from __future__ import annotations

import html
import re

from pyspark.sql import DataFrame

from quire.schema import ITEM, PARAGRAPH, TITLE, element, table
from quire.sources.reader import read_elements

_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*\Z")
_RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})\Z")
_SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*\Z")
_FENCE = re.compile(r"( {0,3})(`{3,}|~{3,})([^`]*)\Z")
_MARKER = re.compile(r"( {0,3})([-+*]|[0-9]{1,9}[.)])(?:([ \t]+)(.*))?\Z")
_QUOTE = re.compile(r" {0,3}> ?")
_HTML = re.compile(r" {0,3}<(?:/?(?:address|article|aside|body|blockquote|center|details|div|dl|fieldset|figure|footer|form|h[1-6]|head|header|hr|html|iframe|li|link|main|menu|nav|ol|p|section|script|style|pre|summary|table|tbody|td|tfoot|th|thead|title|tr|ul)(?:[\s/>]|\Z)|!--|\?|![A-Z])", re.I)
_REFERENCE = re.compile(r" {0,3}\[((?:[^\[\]\\]|\\.)+)\]:[ \t]*<?([^\s<>]+)>?(?:[ \t]+(?:\"[^\"]*\"|'[^']*'|\([^)]*\)))?[ \t]*\Z")
_DELIMITER = re.compile(r" {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*\Z")
_PLAIN = re.compile(r"[^\\`*_~\[\]!<&\n]+")
_ESCAPED = re.compile(r"\\([!-/:-@\[-`{-~])")
_ENTITY = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);")
_AUTOLINK = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[^\s<>@]+@[^\s<>@]+)>")
_TAG = re.compile(r"</?[A-Za-z][^<>]*>|<!--.*?-->", re.S)


def cells_of(line: str) -> list[str]:
    """Cells of a pipe table's row; `\\|` is a bar."""
    line = line.strip()
    if line.startswith("|"):
        line = line[1:]
    if line.endswith("|") and not line.endswith("\\|"):
        line = line[:-1]
    return [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", line)]


_RUNS = re.compile(r"\\.|(?<!`)(`+)(?!`).*?(?<!`)\1(?!`)|([*_~])\2*", re.S)


def emphasis(text: str) -> dict[int, int]:
    """Signs that stay literal at each delimiter run: closers are matched with the nearest openers."""
    runs: list[list] = []  # place, sign, signs left, opens, closes
    for m in _RUNS.finditer(text):
        c = m[2]
        if not c:
            continue
        before, after = text[m.start() - 1] if m.start() else " ", text[m.end()] if m.end() < len(text) else " "
        mark = lambda x: not x.isalnum() and not x.isspace()
        left = not after.isspace() and (not mark(after) or before.isspace() or mark(before))
        right = not before.isspace() and (not mark(before) or after.isspace() or mark(after))
        opens, closes = (left and (not right or mark(before)), right and (not left or mark(after))) if c == "_" else (left, right)
        if c == "~" and len(m.group()) > 2:
            opens = closes = False
        runs.append([m.start(), c, len(m.group()), opens, closes])
    waiting: dict[str, list[int]] = {"*": [], "_": [], "~": []}  # openers with signs left, latest last
    for k, run in enumerate(runs):
        while run[4] and run[2]:
            stack = waiting[run[1]]
            while stack and not (runs[stack[-1]][3] and runs[stack[-1]][2]):
                stack.pop()
            if not stack:
                break
            j = stack[-1]
            used = min(2, run[2], runs[j][2]) if run[1] != "~" else min(run[2], runs[j][2])
            run[2] -= used
            runs[j][2] -= used
            for other in waiting.values():  # openers between the two are closed off
                while other and other[-1] > j:
                    other.pop()
        if run[3] and run[2]:
            waiting[run[1]].append(k)
    return {r[0]: r[2] for r in runs}


def inline(text: str, references: dict[str, str]) -> tuple[str, list[dict]]:
    """The text without markup, and its links with their ranges."""
    out: list[str] = []
    links: list[dict] = []
    size = i = 0
    n = len(text)
    literal = emphasis(text)
    # the bracket that closes each one that opens
    partner: dict[int, int] = {}
    opened: list[int] = []
    for k, ch in enumerate(text):
        if ch in "[]" and (k == 0 or text[k - 1] != "\\"):
            if ch == "[":
                opened.append(k)
            elif opened:
                partner[opened.pop()] = k

    def put(s: str) -> None:
        nonlocal size
        out.append(s)
        size += len(s)

    while i < n:
        m = _PLAIN.match(text, i)
        if m:
            put(m.group())
            i = m.end()
            continue
        c = text[i]
        if c == "\n":
            if out and out[-1].endswith((" ", "\\")):
                last = out[-1].rstrip(" ")
                size -= len(out[-1]) - len(last)
                out[-1] = last
            put(" ")
            i += 1
            while i < n and text[i] in " \t":
                i += 1
        elif c == "\\":
            m = _ESCAPED.match(text, i)
            if m:
                put(m[1])
                i += 2
            else:
                if not text.startswith("\\\n", i):
                    put(c)
                i += 1
        elif c == "`":
            run = re.match("`+", text[i:]).group()
            close = re.compile(rf"(?<!`){run}(?!`)").search(text, i + len(run))
            if close:
                body = text[i + len(run) : close.start()].replace("\n", " ")
                put(body[1:-1] if len(body) > 2 and body[0] == body[-1] == " " and body.strip() else body)
                i = close.end()
            else:
                put(run)
                i += len(run)
        elif c in "*_~":
            run = re.match(rf"\{c}+", text[i:]).group()
            put(c * literal.get(i, len(run)))
            i += len(run)
        elif c == "!" and text.startswith("![", i):
            i += 1
        elif c == "[":
            depth = i not in partner
            end = n if depth else partner[i] + 1
            label = text[i + 1 : end - 1]
            if label.startswith("^") and not depth and label.lower() in references:  # a footnote's mark
                i = end
                continue
            target = re.compile(r"\(\s*(?:<([^<>\n]*)>|((?:[^\s()\\]|\\.|\([^\s()]*\))*))(?:\s+(?:\"[^\"]*\"|'[^']*'|\([^()]*\)))?\s*\)").match(text, end) if not depth else None
            uri, stop = None, end
            if target:
                uri, stop = target[1] if target[1] is not None else target[2], target.end()
            elif not depth:
                named = re.compile(r"\[([^\[\]]*)\]").match(text, end)
                uri = references.get(" ".join(((named[1] if named else "") or label).lower().split()))
                stop = named.end() if named and uri is not None else end
            if uri is None:
                put("[")
                i += 1
            else:
                image = i > 0 and text[i - 1] == "!"
                words, inner = inline(label, references)
                if not image and words:
                    links.append({"uri": html.unescape(_ESCAPED.sub(r"\1", uri)), "begin": size, "end": size + len(words)})
                else:
                    links += [x | {"begin": x["begin"] + size, "end": x["end"] + size} for x in inner]
                put(words)
                i = stop
        elif c == "<":
            m = _AUTOLINK.match(text, i)
            tag = None if m else _TAG.match(text, i)
            if m:
                links.append({"uri": ("mailto:" if "@" in m[1] and ":" not in m[1] else "") + m[1], "begin": size, "end": size + len(m[1])})
                put(m[1])
            elif not tag:
                put("<")
            i = (m or tag).end() if m or tag else i + 1
        elif c == "&":
            m = _ENTITY.match(text, i)
            put(html.unescape(m.group()) if m else "&")
            i = m.end() if m else i + 1
        else:
            put(c)
            i += 1
    return "".join(out), links


_FOOTNOTE = re.compile(r" {0,3}\[\^([^\]\s]+)\]:[ \t]*(.*)")


class _Blocks:
    def __init__(self, references: dict[str, str]):
        self.references, self.out = references, []

    def emit(self, kind: str, raw: str, level: int | None = None) -> None:
        text, links = inline(raw, self.references)
        lead = len(text) - len(text.lstrip())
        text = text.strip()
        if text:
            kept = [{"uri": x["uri"], "begin": max(x["begin"] - lead, 0), "end": min(x["end"] - lead, len(text))} for x in links]
            self.out.append(element(kind, text, level, [x for x in kept if x["begin"] < x["end"]]))

    def run(self, lines: list[str], kind: str | None = PARAGRAPH) -> None:
        """`kind`: what a paragraph becomes; in a tight item the text is the item's."""
        i, n = 0, len(lines)
        para: list[str] = []

        def flush(as_kind: str = PARAGRAPH) -> None:
            if para:
                self.emit(as_kind, "\n".join(x.lstrip() for x in para))
                para.clear()

        while i < n:
            line = lines[i]
            if not line.strip():
                flush(kind)
                i += 1
                continue
            fence, atx, marker = _FENCE.match(line), _ATX.match(line), _MARKER.match(line)
            if fence:
                flush(kind)
                body, i = [], i + 1
                while i < n and not re.match(rf" {{0,3}}{re.escape(fence[2][0])}{{{len(fence[2])},}}[ \t]*\Z", lines[i]):
                    body.append(re.sub(rf"^ {{0,{len(fence[1])}}}", "", lines[i]))
                    i += 1
                i += 1
                if "\n".join(body).strip():
                    self.out.append(element(PARAGRAPH, "\n".join(body).rstrip()))
            elif atx:
                flush(kind)
                self.emit(TITLE, atx[2] or "", len(atx[1]))
                i += 1
            elif para and _SETEXT.match(line):
                level = 1 if "=" in line else 2
                raw = "\n".join(x.lstrip() for x in para)
                para.clear()
                self.emit(TITLE, raw, level)
                i += 1
            elif _RULE.match(line):
                flush(kind)
                i += 1
            elif _QUOTE.match(line):
                flush(kind)
                body = []
                while i < n and lines[i].strip() and (_QUOTE.match(lines[i]) or (body and not _MARKER.match(lines[i]) and not _ATX.match(lines[i]))):
                    body.append(_QUOTE.sub("", lines[i], count=1))
                    i += 1
                self.run(body)
            elif marker and (not para or (marker[4] and (marker[2] in "-+*" or marker[2][:-1] == "1"))):
                flush(PARAGRAPH)
                i = self.list(lines, i)
            elif line.startswith(("    ", "\t")) and not para:
                body = []
                while i < n and (not lines[i].strip() or lines[i].startswith(("    ", "\t"))):
                    body.append(re.sub(r"^(?: {4}|\t)", "", lines[i]))
                    i += 1
                self.out.append(element(PARAGRAPH, "\n".join(body).rstrip()))
            elif not para and _HTML.match(line):
                while i < n and lines[i].strip():
                    i += 1
            elif not para and _FOOTNOTE.match(line):
                para.append(_FOOTNOTE.match(line)[2])  # the note's text, where it stands
                i += 1
            elif not para and _REFERENCE.match(line):
                i += 1
            elif i + 1 < n and "|" in line and _DELIMITER.match(lines[i + 1]) and len(cells_of(line)) == len(cells_of(lines[i + 1])):
                flush(kind)
                rows, i = [cells_of(line)], i + 2
                while i < n and lines[i].strip() and not _FENCE.match(lines[i]) and not _ATX.match(lines[i]) and not _QUOTE.match(lines[i]):
                    rows.append(cells_of(lines[i]))
                    i += 1
                width = len(rows[0])
                grid = [[inline(c, self.references)[0].strip() for c in (r + [""] * width)[:width]] for r in rows]
                self.out.append(table(grid, 1))
            else:
                para.append(line)
                i += 1
        flush(kind)

    def list(self, lines: list[str], i: int) -> int:
        """One list from line i; returns the line after it."""
        items, loose, n = [], False, len(lines)
        sign = _MARKER.match(lines[i])[2][-1]
        while i < n:
            m = _MARKER.match(lines[i])
            if not m or m[2][-1] != sign or _RULE.match(lines[i]):
                break
            gap = m[3] or " "
            pad = len(m[1]) + len(m[2]) + (len(gap.expandtabs(4)) if 1 <= len(gap.expandtabs(4)) <= 4 else 1)
            body, i, blank = [m[4] or ""], i + 1, False
            while i < n:
                line = lines[i].expandtabs(4)
                if not line.strip():
                    blank = True
                    body.append("")
                elif len(line) - len(line.lstrip()) >= pad:
                    loose, blank = loose or (blank and len(line) - len(line.lstrip()) == pad), False
                    body.append(line[pad:])
                elif blank or _MARKER.match(line) or _ATX.match(line) or _FENCE.match(line) or _QUOTE.match(line) or _RULE.match(line):
                    break
                else:
                    body.append(line.lstrip())
                i += 1
            after = blank and i < n and _MARKER.match(lines[i]) and _MARKER.match(lines[i])[2][-1] == sign
            loose = loose or bool(after)
            while body and not body[-1].strip():
                body.pop()
            items.append(body)
        for body in items:
            self.run(body, PARAGRAPH if loose else ITEM)
        return i


def parse(source: str) -> list[dict]:
    lines = source.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    references: dict[str, str] = {}
    for line in lines:
        note = _FOOTNOTE.match(line)
        m = None if note else _REFERENCE.match(line)
        if note:
            references.setdefault("^" + note[1].lower(), "")
        elif m:
            references.setdefault(" ".join(m[1].lower().split()), m[2])
    blocks = _Blocks(references)
    blocks.run(lines)
    return blocks.out


def read_markdown(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep_empty: bool = False) -> DataFrame:
    return read_elements(docs, text, doc_id, parse, "markdown", keep_empty=keep_empty)
