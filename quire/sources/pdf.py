"""PDF reader: glyphs, rules, fills, images, outline, links and form fields of every page.

Plain Python over the file's objects; streams may be Flate-packed and objects may lie in
object streams.  Encrypted files and fonts without any mapping give glyphs without text.
A file that can't be read gives one row with `error`.  Coordinates run down from the top
of the page.  Boxes of glyphs come from the font's size, widths and a usual rise and fall.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Matrix = tuple[float, float, float, float, float, float]
ONE: Matrix = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
RISE, FALL = 0.80, 0.22


class Ref:
    def __init__(self, number: int):
        self.number = number


class Name(str):
    pass


class Stream:
    def __init__(self, info: dict, raw: bytes):
        self.info, self.raw = info, raw


_GAP = re.compile(rb"(?:[\x00\t\n\f\r ]+|%[^\r\n]*)+")
_TOKEN = re.compile(rb"<<|>>|[\[\]{}]|/[^\x00\t\n\f\r ()<>\[\]{}/%]*|[+-]?(?:\d+\.?\d*|\.\d+)|[^\x00\t\n\f\r ()<>\[\]{}/%]+")
_REF = re.compile(rb"(\d+)[\x00\t\n\f\r ]+(\d+)[\x00\t\n\f\r ]+R(?![A-Za-z])")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Parser:
    """Values, one after the other; keywords come as bytes."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def blank(self) -> None:
        m = _GAP.match(self.data, self.at)
        if m:
            self.at = m.end()

    def value(self):
        self.blank()
        d, at = self.data, self.at
        if at >= len(d):
            return None
        c = d[at : at + 1]
        if c == b"(":
            return self._literal()
        if c == b"<" and d[at : at + 2] != b"<<":
            end = d.find(b">", at)
            end = len(d) if end < 0 else end
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", d[at + 1 : end])
            self.at = end + 1
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        m = _REF.match(d, at)
        if m:
            self.at = m.end()
            return Ref(int(m[1]))
        m = _TOKEN.match(d, at)
        if not m:
            self.at += 1
            return self.value()
        self.at, t = m.end(), m.group()
        if t == b"<<":
            out = {}
            while True:
                key = self.value()
                if key is None or key == b">>":
                    return out
                value = self.value()
                if value == b">>":
                    return out
                out[str(key)] = value
        if t == b"[":
            items = []
            while True:
                item = self.value()
                if item is None and self.at >= len(d) or item == b"]":
                    return items
                items.append(item)
        if t[:1] == b"/":
            return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), t[1:]).decode("latin-1"))
        if re.fullmatch(rb"[+-]?(?:\d+\.?\d*|\.\d+)", t):
            return float(t) if b"." in t else int(t)
        return {b"true": True, b"false": False, b"null": None}.get(t, t)

    def _literal(self) -> bytes:
        d, at, depth, out = self.data, self.at + 1, 1, bytearray()
        while at < len(d):
            c = d[at : at + 1]
            if c == b"\\":
                e = d[at + 1 : at + 2]
                m = re.compile(rb"[0-7]{1,3}").match(d, at + 1)
                if m:
                    out.append(int(m.group(), 8) & 255)
                    at = m.end()
                    continue
                if e not in b"\r\n":
                    out += _ESCAPES.get(e, e)
                at += 3 if d[at + 1 : at + 3] == b"\r\n" else 2
                continue
            depth += (c == b"(") - (c == b")")
            if not depth:
                break
            out += c
            at += 1
        self.at = at + 1
        return bytes(out)


class File:
    """Objects of a file by number, found by looking for them rather than by its table."""

    def __init__(self, data: bytes):
        if b"%PDF" not in data[:1024]:
            raise ValueError("no PDF")
        self.objects: dict[int, object] = {}
        self.trailer: dict = {}
        for m in re.finditer(rb"(?<!\d)(\d+)[\x00\t\n\f\r ]+\d+[\x00\t\n\f\r ]+obj\b", data):
            p = Parser(data, m.end())
            value = p.value()
            if isinstance(value, dict):
                p.blank()
                if data.startswith(b"stream", p.at):
                    begin = p.at + 6 + (2 if data[p.at + 6 : p.at + 8] == b"\r\n" else 1)
                    size = value.get("Length")
                    end = begin + size if isinstance(size, int) and data[begin + size : begin + size + 20].lstrip().startswith(b"endstream") else data.find(b"endstream", begin)
                    value = Stream(value, data[begin : end if end >= 0 else len(data)])
            self.objects[int(m[1])] = value
        for m in re.finditer(rb"trailer", data):
            found = Parser(data, m.end()).value()
            self.trailer |= found if isinstance(found, dict) else {}
        for s in [o for o in self.objects.values() if isinstance(o, Stream)]:
            if s.info.get("Type") == "XRef":
                self.trailer = s.info | self.trailer
            if s.info.get("Type") == "ObjStm":
                body = self.unpacked(s)
                head = Parser(body)
                pairs = [(head.value(), head.value()) for _ in range(int(self.get(s.info.get("N"), 0)))]
                for number, at in pairs:
                    self.objects.setdefault(number, Parser(body, int(self.get(s.info["First"])) + at).value())
        if "Encrypt" in self.trailer:
            raise ValueError("encrypted")

    def get(self, value, default=None):
        for _ in range(32):
            if not isinstance(value, Ref):
                break
            value = self.objects.get(value.number)
        return default if value is None else value

    def dict_of(self, value) -> dict:
        value = self.get(value, {})
        return value.info if isinstance(value, Stream) else value if isinstance(value, dict) else {}

    def unpacked(self, s: Stream) -> bytes:
        data = s.raw
        filters = self.get(s.info.get("Filter"), [])
        parms = self.get(s.info.get("DecodeParms"), [])
        for i, f in enumerate(filters if isinstance(filters, list) else [filters]):
            if self.get(f) in ("FlateDecode", "Fl"):
                data = zlib.decompressobj().decompress(data)
                own = self.dict_of(parms[i] if isinstance(parms, list) and i < len(parms) else parms if isinstance(parms, (dict, Ref)) else {})
                if self.get(own.get("Predictor"), 1) >= 10:
                    data = _unpredicted(data, self.get(own.get("Columns"), 1) * self.get(own.get("Colors"), 1) * self.get(own.get("BitsPerComponent"), 8) // 8, max(1, self.get(own.get("Colors"), 1)))
            elif self.get(f) in ("ASCIIHexDecode", "AHx"):
                data = bytes.fromhex(re.sub(rb"[^0-9A-Fa-f]", b"", data).decode())
        return data

    def pages(self) -> list[dict]:
        root = self.dict_of(self.trailer.get("Root")) or next((self.dict_of(o) for o in self.objects.values() if self.dict_of(o).get("Type") == "Catalog"), {})
        out: list[dict] = []
        todo = [(root.get("Pages"), {})]
        seen: set[int] = set()
        while todo:
            ref, passed = todo.pop()
            if isinstance(ref, Ref):
                if ref.number in seen:
                    continue
                seen.add(ref.number)
            node = self.dict_of(ref)
            own = passed | {k: node[k] for k in ("MediaBox", "Resources", "Rotate") if k in node}
            if "Kids" in node:
                todo += [(k, own) for k in reversed(self.get(node["Kids"], []))]
            elif node:
                out.append(node | own | {"__number": ref.number if isinstance(ref, Ref) else -1})
        self.root = root
        return out


def _unpredicted(data: bytes, width: int, step: int) -> bytes:
    out, before = bytearray(), bytearray(width)
    for at in range(0, len(data), width + 1):
        kind, row = data[at], bytearray(data[at + 1 : at + 1 + width])
        for i in range(len(row)):
            a, b, c = (row[i - step] if i >= step else 0), before[i], (before[i - step] if i >= step else 0)
            if kind == 1:
                row[i] = (row[i] + a) & 255
            elif kind == 2:
                row[i] = (row[i] + b) & 255
            elif kind == 3:
                row[i] = (row[i] + (a + b) // 2) & 255
            elif kind == 4:
                p = a + b - c
                row[i] = (row[i] + min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]) & 255
        out += row
        before = row + bytearray(width - len(row))
    return bytes(out)


def decoded(b) -> str:
    """A text string of a file: UTF-16 with its mark, else one byte a character."""
    if not isinstance(b, bytes):
        return "" if b is None else str(b)
    return b[2:].decode("utf-16-be", "replace") if b[:2] == b"\xfe\xff" else b[3:].decode("utf-8", "replace") if b[:3] == b"\xef\xbb\xbf" else b.decode("latin-1")


def times(a: Matrix, b: Matrix) -> Matrix:
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


def at(m: Matrix, x: float, y: float) -> tuple[float, float]:
    return x * m[0] + y * m[2] + m[4], x * m[1] + y * m[3] + m[5]


_SIGNS = dict(zip("space exclam quotedbl numbersign dollar percent ampersand quotesingle parenleft parenright asterisk plus comma hyphen period slash colon semicolon less equal greater question at bracketleft backslash bracketright underscore braceleft bar braceright bullet endash emdash quoteleft quoteright quotedblleft quotedblright fi fl zero one two three four five six seven eight nine".split(), [*" !\"#$%&'()*+,-./:;<=>?@[\\]_{|}•–—‘’“”ﬁﬂ0123456789"]))


class Font:
    def __init__(self, file: File, info: dict):
        self.two = info.get("Subtype") == "Type0"
        self.name = str(file.get(info.get("BaseFont"), ""))
        low = self.name.lower()
        inner = file.dict_of((file.get(info.get("DescendantFonts"), []) or [None])[0]) if self.two else info
        told = file.get(file.dict_of(inner.get("FontDescriptor")).get("FontWeight"))
        self.weight = int(told) if isinstance(told, (int, float)) else 700 if any(w in low for w in ("bold", "black", "heavy")) or ("medi" in low and "medium" not in low) else 400
        self.text: dict[int, str] = {}
        encoding = file.get(info.get("Encoding"))
        base = encoding if isinstance(encoding, str) else file.dict_of(encoding).get("BaseEncoding", "")
        if not self.two:
            codec = "mac_roman" if base == "MacRomanEncoding" else "cp1252"
            self.text = {c: bytes([c]).decode(codec, "ignore") for c in range(32, 256)}
            code = 0
            for x in file.get(file.dict_of(encoding).get("Differences"), []) if isinstance(encoding, dict) else []:
                if isinstance(x, int):
                    code = x
                else:
                    self.text[code] = x if len(x) == 1 else chr(int(x[3:7], 16)) if re.fullmatch("uni[0-9A-F]{4}", x) else _SIGNS.get(x, "")
                    code += 1
        to = file.get(info.get("ToUnicode"))
        if isinstance(to, Stream):
            self.text |= unicode_map(file.unpacked(to))
        self.widths: dict[int, float] = {}
        self.usual = 600.0 if "courier" in low else 500.0
        if self.two:
            self.usual = float(file.get(inner.get("DW"), 1000))
            w = file.get(inner.get("W"), [])
            i = 0
            while i + 1 < len(w):
                first, second = file.get(w[i]), file.get(w[i + 1])
                if isinstance(second, list):
                    self.widths |= {first + k: float(file.get(x)) for k, x in enumerate(second)}
                    i += 2
                else:
                    self.widths |= {c: float(file.get(w[i + 2])) for c in range(first, min(second, 65535) + 1)}
                    i += 3
        else:
            first = int(file.get(info.get("FirstChar"), 0))
            self.widths = {first + k: float(file.get(x, 0)) for k, x in enumerate(file.get(info.get("Widths"), []))}

    def codes(self, s: bytes) -> list[int]:
        return [int.from_bytes(s[i : i + 2], "big") for i in range(0, len(s) - 1, 2)] if self.two else list(s)


def unicode_map(cmap: bytes) -> dict[int, str]:
    out: dict[int, str] = {}
    word = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
        for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]*)>", block):
            out[int(a, 16)] = word(b)
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
        for a, b, c, many in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(?:<([0-9A-Fa-f]+)>|\[(.*?)\])", block, re.S):
            low, high = int(a, 16), min(int(b, 16), int(a, 16) + 65535)
            if many:
                out |= {low + k: word(x) for k, x in enumerate(re.findall(rb"<([0-9A-Fa-f]*)>", many))}
            elif c:
                start = word(c)
                out |= {code: start[:-1] + chr(ord(start[-1]) + code - low) for code in range(low, high + 1) if start}
    return out


class Page:
    """Runs the content of a page: what it prints and draws."""

    def __init__(self, file: File, info: dict, index: int):
        box = [float(file.get(v)) for v in file.get(info.get("MediaBox"), [0, 0, 612, 792])]
        self.file, self.index = file, index
        self.left, self.width, self.top, self.height = min(box[0], box[2]), abs(box[2] - box[0]), max(box[1], box[3]), abs(box[3] - box[1])
        self.glyphs, self.shapes, self.images = [], [], []
        self.fonts: dict[int, Font] = {}
        contents = file.get(info.get("Contents"), [])
        parts = [file.get(c) for c in (contents if isinstance(contents, list) else [contents])]
        self.run(b"\n".join(file.unpacked(s) for s in parts if isinstance(s, Stream)), file.dict_of(info.get("Resources")), ONE, 0)

    def spot(self, x: float, y: float) -> tuple[float, float]:
        return x - self.left, self.top - y

    def box(self, points: list[tuple[float, float]]) -> tuple[float, float, float, float]:
        flipped = [self.spot(*p) for p in points]
        xs, ys = [p[0] for p in flipped], [p[1] for p in flipped]
        return min(xs), min(ys), max(xs), max(ys)

    def show(self, s: bytes, t: dict, ctm: Matrix) -> None:
        font: Font | None = t["font"]
        if font is None:
            return
        for code in font.codes(s):
            m = times((t["size"] * t["scale"], 0, 0, t["size"], 0, t["rise"]), times(t["m"], ctm))
            width = font.widths.get(code, font.usual) / 1000
            text = font.text.get(code, "")
            x, y = at(m, 0, 0)
            size, advance = math.hypot(m[2], m[3]), width * math.hypot(m[0], m[1])
            box = self.box([at(m, a, b) for a in (0, width) for b in (-FALL, RISE)]) if text.strip() else (None,) * 4
            ox, oy = self.spot(x, y)
            if -1 <= ox <= self.width + 1 and -1 <= oy <= self.height + 1:
                self.glyphs.append((self.index, len(self.glyphs), text, *box, ox, oy, size, advance, font.weight, math.degrees(math.atan2(m[1], m[0])), font.name))
            step = width * t["size"] + t["char"] + (t["word"] if code == 32 and not font.two else 0)
            t["m"] = times((1, 0, 0, 1, step * t["scale"], 0), t["m"])

    def run(self, content: bytes, resources: dict, ctm: Matrix, depth: int) -> None:
        file, p = self.file, Parser(content)
        fonts, forms = file.dict_of(resources.get("Font")), file.dict_of(resources.get("XObject"))
        t = {"font": None, "size": 1.0, "scale": 1.0, "rise": 0.0, "char": 0.0, "word": 0.0, "lead": 0.0, "m": ONE, "line": ONE}
        kept: list = []
        args: list = []
        path: list[tuple[float, float]] = []

        def move(x: float, y: float) -> None:
            t["line"] = t["m"] = times((1, 0, 0, 1, x, y), t["line"])

        while True:
            v = p.value()
            if v is None and p.at >= len(content):
                break
            if not isinstance(v, bytes) or isinstance(v, bytes) and content[p.at - 1 : p.at] in (b")", b">"):
                args.append(v)
                continue
            n = [a for a in args if isinstance(a, (int, float))]
            try:
                if v == b"q":
                    kept.append((ctm, dict(t)))
                elif v == b"Q" and kept:
                    ctm, t = kept.pop()
                elif v == b"cm":
                    ctm = times(tuple(map(float, n[-6:])), ctm)
                elif v == b"BT":
                    t["m"] = t["line"] = ONE
                elif v == b"Tf":
                    ref = fonts.get(str(args[0]))
                    key = ref.number if isinstance(ref, Ref) else id(ref)
                    if key not in self.fonts:
                        self.fonts[key] = Font(file, file.dict_of(ref))
                    t["font"], t["size"] = self.fonts[key], float(n[-1])
                elif v in (b"Tc", b"Tw", b"TL", b"Ts"):
                    t[{b"Tc": "char", b"Tw": "word", b"TL": "lead", b"Ts": "rise"}[v]] = float(n[-1])
                elif v == b"Tz":
                    t["scale"] = n[-1] / 100
                elif v in (b"Td", b"TD"):
                    if v == b"TD":
                        t["lead"] = -n[-1]
                    move(n[-2], n[-1])
                elif v == b"Tm":
                    t["m"] = t["line"] = tuple(map(float, n[-6:]))
                elif v == b"T*":
                    move(0, -t["lead"])
                elif v in (b"Tj", b"'", b'"'):
                    if v != b"Tj":
                        if v == b'"':
                            t["word"], t["char"] = n[0], n[1]
                        move(0, -t["lead"])
                    self.show(args[-1], t, ctm)
                elif v == b"TJ":
                    for x in args[-1]:
                        if isinstance(x, bytes):
                            self.show(x, t, ctm)
                        elif isinstance(x, (int, float)):
                            t["m"] = times((1, 0, 0, 1, -x / 1000 * t["size"] * t["scale"], 0), t["m"])
                elif v == b"re":
                    x, y, w, h = n[-4:]
                    path += [at(ctm, x, y), at(ctm, x + w, y), at(ctm, x, y + h), at(ctm, x + w, y + h)]
                elif v in (b"m", b"l", b"c", b"v", b"y"):
                    path += [at(ctm, n[i], n[i + 1]) for i in range(0, len(n) - 1, 2)]
                elif v in (b"S", b"s", b"f", b"F", b"f*", b"B", b"B*", b"b", b"b*"):
                    if path:
                        self.shapes.append((self.index, *self.box(path)))
                    path = []
                elif v == b"n":
                    path = []
                elif v == b"Do" and depth < 8:
                    form = file.get(forms.get(str(args[-1])))
                    if isinstance(form, Stream) and form.info.get("Subtype") == "Form":
                        inner = tuple(float(file.get(x)) for x in file.get(form.info.get("Matrix"), list(ONE)))
                        self.run(file.unpacked(form), file.dict_of(form.info.get("Resources")) or resources, times(inner, ctm), depth + 1)
                    elif isinstance(form, Stream):
                        self.images.append((self.index, *self.box([at(ctm, x, y) for x in (0, 1) for y in (0, 1)]), texty(file, form)))
                elif v == b"BI":
                    end = re.compile(rb"\sEI(?=\s|$)").search(content, p.at)
                    p.at = end.end() if end else len(content)
                    self.images.append((self.index, *self.box([at(ctm, x, y) for x in (0, 1) for y in (0, 1)]), False))
            except (IndexError, KeyError, TypeError, ValueError):
                pass  # an operator without its operands draws nothing
            args = []


def looks_like_text(gray: np.ndarray) -> bool:
    """Most pixels dark or light, and many rows that change between them often."""
    if gray.size == 0:
        return False
    low, high = int(gray.min()), int(gray.max())
    if high - low < 64 or ((gray < 64) | (gray > 191)).mean() < 0.55:
        return False
    ink = gray > (low + high) / 2
    return bool(((ink[:, 1:] != ink[:, :-1]).sum(axis=1) >= 6).mean() >= 0.18)


def texty(file: File, image: Stream) -> bool:
    """Whether a picture of plain samples looks like text; others aren't decoded."""
    w, h, bits = (int(file.get(image.info.get(k), 0)) for k in ("Width", "Height", "BitsPerComponent"))
    channels = {"DeviceGray": 1, "DeviceRGB": 3}.get(str(file.get(image.info.get("ColorSpace"))), 0)
    filters = file.get(image.info.get("Filter"), [])
    if bits != 8 or not channels or any(file.get(f) not in ("FlateDecode", "Fl") for f in (filters if isinstance(filters, list) else [filters])):
        return False
    data = np.frombuffer(file.unpacked(image), np.uint8)
    if len(data) < w * h * channels:
        return False
    gray = data[: w * h * channels].reshape(h, w, channels).mean(axis=2)
    return looks_like_text(gray[:: max(1, h // 256), :: max(1, w // 256)])


# ---- outline, links, fields --------------------------------------------------------------


def destination(file: File, dest, numbers: dict[int, int], tops: list[float]) -> tuple[int | None, float | None]:
    dest = file.get(dest)
    if isinstance(dest, (bytes, str)):
        names = file.dict_of(file.root.get("Dests"))
        dest = file.get(names.get(decoded(dest)))
        dest = file.get(dest.get("D")) if isinstance(dest, dict) else dest
    if not isinstance(dest, list) or not dest:
        return None, None
    page = numbers.get(dest[0].number) if isinstance(dest[0], Ref) else dest[0] if isinstance(dest[0], int) else None
    y = next((float(v) for v in ([file.get(x) for x in dest[3:4]] if len(dest) > 2 and dest[1] == "XYZ" else [file.get(x) for x in dest[2:3]]) if isinstance(v, (int, float))), None)
    return page, None if y is None or page is None or page >= len(tops) else tops[page] - y


def outline(file: File, numbers: dict[int, int], tops: list[float], most: int = 20_000) -> list[tuple]:
    """(title, level, page, y) of the bookmarks, in order."""
    out: list[tuple] = []
    todo = [(file.dict_of(file.root.get("Outlines")).get("First"), 1)]
    seen: set[int] = set()
    while todo and len(out) < most:
        ref, level = todo.pop()
        if not isinstance(ref, Ref) or ref.number in seen or level > 32:
            continue
        seen.add(ref.number)
        item = file.dict_of(ref)
        dest = item.get("Dest") or file.dict_of(item.get("A")).get("D")
        title = decoded(file.get(item.get("Title"))).strip()
        if title:
            out.append((title, level, *destination(file, dest, numbers, tops)))
        todo += [(item.get("Next"), level), (item.get("First"), level + 1)]
    return out


def annotations(file: File, pages: list[dict], numbers: dict[int, int], tops: list[float]) -> tuple[list[tuple], list[tuple]]:
    """Links (page, x0, y0, x1, y1, uri, target page) and fields (page, name, kind, value, x0, y0, x1, y1)."""
    links, fields = [], []
    for index, page in enumerate(pages):
        box = [float(file.get(v)) for v in file.get(page.get("MediaBox"), [0, 0, 612, 792])]
        for ref in file.get(page.get("Annots"), []):
            a = file.dict_of(ref)
            r = [float(file.get(v, 0)) for v in file.get(a.get("Rect"), [0, 0, 0, 0])]
            rect = (min(r[0], r[2]) - box[0], tops[index] - max(r[1], r[3]), max(r[0], r[2]) - box[0], tops[index] - min(r[1], r[3]))
            if a.get("Subtype") == "Link":
                act = file.dict_of(a.get("A"))
                uri = decoded(file.get(act.get("URI"))) or None
                target = None if uri else destination(file, a.get("Dest") or act.get("D"), numbers, tops)[0]
                if uri or (target is not None and target != index):
                    links.append((index, *rect, uri, target))
            elif a.get("Subtype") == "Widget":
                names, kind, value, node = [], None, None, a
                for _ in range(32):
                    names += [decoded(file.get(node.get("T")))] if "T" in node else []
                    kind, value = kind or file.get(node.get("FT")), value if value is not None else file.get(node.get("V"))
                    if "Parent" not in node:
                        break
                    node = file.dict_of(node["Parent"])
                fields.append((index, ".".join(reversed(names)), {"Tx": "text", "Btn": "button", "Ch": "choice", "Sig": "signature"}.get(kind, "unknown"), decoded(value) or None, *rect))
    return links, fields


PARTS = {
    "pages": "page int, width double, height double",
    "glyphs": "page int, draw_index int, text string, x0 double, y0 double, x1 double, y1 double, origin_x double, origin_y double, font_size double, advance double, weight int, rotation_deg double, face string",
    "shapes": "page int, x0 double, y0 double, x1 double, y1 double",
    "images": "page int, x0 double, y0 double, x1 double, y1 double, texty boolean",
    "outline": "title string, level int, page int, y double",
    "links": "page int, x0 double, y0 double, x1 double, y1 double, uri string, target int",
    "fields": "page int, name string, kind string, value string, x0 double, y0 double, x1 double, y1 double",
}


def parse(content: bytes, part: str) -> list[tuple]:
    """Rows of one part of a file, in the columns of PARTS."""
    file = File(content)
    pages = file.pages()
    if not pages:
        raise ValueError("no pages")
    numbers = {p["__number"]: i for i, p in enumerate(pages)}
    boxes = [[float(file.get(v)) for v in file.get(p.get("MediaBox"), [0, 0, 612, 792])] for p in pages]
    tops = [max(b[1], b[3]) for b in boxes]
    if part == "pages":
        return [(i, abs(b[2] - b[0]), abs(b[3] - b[1])) for i, b in enumerate(boxes)]
    if part == "outline":
        return outline(file, numbers, tops)
    if part in ("links", "fields"):
        return annotations(file, pages, numbers, tops)[part == "fields"]
    return [row for i, p in enumerate(pages) for row in getattr(Page(file, p, i), part)]


def read_pdf(files: DataFrame, part: str, content: str = "content", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, error and the columns of a part (see PARTS) of every file; one map, nothing is shuffled."""
    schema = f"doc_id long, error string, {PARTS[part]}"
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, data in zip(batch.iloc[:, 0], batch.iloc[:, 1]):
                try:
                    rows = [(key, None, *r) for r in parse(bytes(data), part)] if data is not None else []
                except Exception as problem:  # noqa: BLE001 - told in the row
                    rows = [(key, f"{type(problem).__name__}: {problem}", *(None,) * (len(names) - 2))]
                if rows:
                    yield pd.DataFrame(rows, columns=names).astype({n: "Int64" for n, k in (f.split() for f in schema.split(", ")) if k in ("int", "long")})

    return files.select(F.col(doc_id).cast("long"), F.col(content)).mapInPandas(run, schema)


def rules_and_fills(shapes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Painted paths as rules (orient H or V) and fills."""
    from quire.operators.layout import classify_path

    kind = shapes.where("error IS NULL").withColumn("orient", classify_path(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")))
    return kind.where("orient IN ('H', 'V')").drop("error"), kind.where("orient = 'fill'").drop("error", "orient")
