"""Texts of a PDF's pages, in plain Python: what ``readers.pages_of`` takes where no other reader is at hand.

Objects are found by their marks, in the file and in object streams; pages by the page tree, in its order. A page's content streams
(plain or deflated) are read for text operators: shown strings follow each other, a move to another line starts one, and a wide gap in a
TJ array is a space. Codes go through the font's ToUnicode map where there is one, else they are Latin-1, with differences by
glyph name for letters. No layout is guessed, nothing is decrypted, and pictures have no text.
"""

from __future__ import annotations

import re
import zlib

_OBJECT = re.compile(rb"(\d+)\s+(\d+)\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
_REF = re.compile(rb"(\d+)\s+\d+\s+R")
_TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/<>\[\]()]+|[-+]?\d*\.?\d+|[A-Za-z'\"*]+[0-9*]?", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
#: Thousandths of an em from which a gap in a TJ array is a space.
GAP = 200


class _File:
    def __init__(self, raw: bytes):
        if not raw.lstrip()[:5] == b"%PDF-":
            raise ValueError("not a PDF")
        if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", raw):
            raise ValueError("an encrypted PDF")
        self.objects: dict[int, bytes] = {int(m[1]): m[3] for m in _OBJECT.finditer(raw)}
        for body in [b for b in self.objects.values() if re.search(rb"/Type\s*/ObjStm\b", b)]:
            data, head = self.stream(body), re.search(rb"/First\s+(\d+)", body)
            numbers = [int(x) for x in data[: int(head[1])].split()]
            places = [*numbers[1::2], len(data) - int(head[1])]
            for n, a, b in zip(numbers[::2], places, places[1:], strict=False):
                self.objects.setdefault(n, data[int(head[1]) + a : int(head[1]) + b])

    def stream(self, body: bytes) -> bytes:
        m = _STREAM.search(body)
        if not m:
            return b""
        head = body[: m.start()]
        if b"/FlateDecode" in head or re.search(rb"/Fl\b", head):
            d = zlib.decompressobj()
            return d.decompress(m[1])
        if b"/Filter" in head:
            return b""  # a filter of pictures
        return m[1]

    def value(self, body: bytes, key: bytes) -> bytes:
        """What follows a key in a dictionary: a dictionary, an array, or up to the next key; a reference is followed."""
        m = re.search(rb"/" + key + rb"(?![A-Za-z0-9])\s*", body)
        if not m:
            return b""
        rest = body[m.end() :]
        if ref := _REF.match(rest):
            return self.objects.get(int(ref[1]), b"")
        for start, end in ((b"<<", b">>"), (b"[", b"]")):
            if rest.startswith(start):
                depth, at = 0, 0
                for mark in re.finditer(re.escape(start) + b"|" + re.escape(end), rest):
                    depth += 1 if mark[0] == start else -1
                    at = mark.end()
                    if not depth:
                        break
                return rest[:at]
        return re.split(rb"[/>\]]", rest[1:] if rest[:1] == b"/" else rest, maxsplit=1)[0].strip()

    def pages(self) -> list[tuple[bytes, bytes]]:
        """(page, resources) in the order of the page tree; without a tree, pages as they stand in the file."""
        found: list[tuple[bytes, bytes]] = []
        seen: set[int] = set()

        def walk(number: int, resources: bytes) -> None:
            body = self.objects.get(number, b"")
            if number in seen or not body:
                return
            seen.add(number)
            resources = self.value(body, b"Resources") or resources
            if re.search(rb"/Type\s*/Pages\b", body) or b"/Kids" in body:
                for ref in _REF.finditer(self.value(body, b"Kids")):
                    walk(int(ref[1]), resources)
            elif re.search(rb"/Type\s*/Page\b", body):
                found.append((body, resources))

        for body in self.objects.values():
            if re.search(rb"/Type\s*/Catalog\b", body) and (root := re.search(rb"/Pages\s+(\d+)\s+\d+\s+R", body)):
                walk(int(root[1]), b"")
        return found or [
            (b, self.value(b, b"Resources")) for _, b in sorted(self.objects.items()) if re.search(rb"/Type\s*/Page\b(?!s)", b)
        ]

    def content(self, page: bytes) -> bytes:
        m = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", page)
        return b"\n".join(self.stream(self.objects.get(int(r[1]), b"")) for r in _REF.finditer(m[1])) if m else b""

    def fonts(self, resources: bytes) -> dict[bytes, _Font]:
        entries = re.finditer(rb"/([^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R", self.value(resources, b"Font"))
        return {m[1]: _Font(self, self.objects.get(int(m[2]), b"")) for m in entries}


class _Font:
    """From codes to text."""

    def __init__(self, file: _File, body: bytes):
        self.map: dict[bytes, str] = {}
        self.width = 2 if re.search(rb"/Subtype\s*/Type0\b", body) else 1
        ref = re.search(rb"/ToUnicode\s+(\d+)\s+\d+\s+R", body)
        table = file.stream(file.objects.get(int(ref[1]), b"")) if ref else b""
        for block in re.findall(rb"beginbfchar(.*?)endbfchar", table, re.S):
            for code, to in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f\s]+)>", block):
                self.map[bytes.fromhex(code.decode())] = _utf16(to)
        for block in re.findall(rb"beginbfrange(.*?)endbfrange", table, re.S):
            for low, high, to in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
                first, n = _utf16(to), len(low) // 2
                for i in range(min(int(high, 16) - int(low, 16), 65535) + 1):
                    self.map[(int(low, 16) + i).to_bytes(n, "big")] = first[:-1] + chr(ord(first[-1]) + i)
        if self.map:
            self.width = len(next(iter(self.map)))
        names, at = re.search(rb"/Differences\s*\[(.*?)\]", file.value(body, b"Encoding") or body, re.S), 0
        for token in names[1].split() if names and not self.map else []:
            for part in re.findall(rb"\d+|/[^/\s]+", token):
                if part[:1] == b"/":
                    if len(part) == 2:  # a letter is its own name
                        self.map[bytes([at & 255])] = part[1:].decode("latin-1")
                    at += 1
                else:
                    at = int(part)

    def text(self, raw: bytes) -> str:
        codes = [raw[i : i + self.width] for i in range(0, len(raw), self.width)]
        return "".join(self.map.get(c, c.decode("cp1252", "replace") if self.width == 1 else "") for c in codes)


def _utf16(digits: bytes) -> str:
    return bytes.fromhex(digits.decode()).decode("utf-16-be", "replace") or "�"


def _string(token: bytes) -> bytes:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())

    def plain(m: re.Match) -> bytes:
        if m[1]:
            return bytes([int(m[1], 8) & 255])
        return b"" if m[2] in (b"\n", b"\r") else _ESCAPES.get(m[2], m[2])

    return re.sub(rb"\\(?:([0-7]{1,3})|(.))", plain, token[1:-1], flags=re.S)


def _shown(content: bytes, fonts: dict[bytes, _Font]) -> str:
    """The text of a page's operators, in their order."""
    out: list[str] = []
    stack: list[bytes] = []
    latin = _Font.__new__(_Font)
    latin.map, latin.width = {}, 1
    font = latin

    def line() -> None:
        if out and out[-1] != "\n":
            out.append("\n")

    for m in _TOKEN.finditer(content):
        token = m[0]
        if token[:1] in b"(<[]/" or token[:1].isdigit() or token[:1] in b"+-.":
            stack.append(token)
            continue
        if token == b"Tf" and len(stack) > 1:
            font = fonts.get(stack[-2][1:], latin)
        elif token in (b"Tj", b"'", b'"') and stack:
            if token != b"Tj":
                line()
            out.append(font.text(_string(stack[-1])))
        elif token == b"TJ":
            start = max((i for i, t in enumerate(stack) if t == b"["), default=0)
            for t in stack[start:]:
                if t[:1] in (b"(", b"<"):
                    out.append(font.text(_string(t)))
                elif t not in (b"[", b"]") and t[:1] != b"/" and float(t) <= -GAP:
                    out.append(" ")
        elif token in (b"Td", b"TD") and len(stack) > 1 and float(stack[-1]) != 0 or token in (b"T*", b"ET"):
            line()
        elif token == b"Tm":
            line()
        stack = []
    return "".join(out).strip("\n")


def page_texts(raw: bytes) -> list[str]:
    """The text of each page, in order. What is no PDF, or an encrypted one, raises."""
    file = _File(raw)
    return [_shown(file.content(page), file.fonts(resources)) for page, resources in file.pages()]


def simple_pdf(pages: list[str], packed: bool = True) -> bytes:
    """A PDF with a page a text, a line a line, in Latin-1: for tests and reports."""
    objects: list[bytes] = [b"<< /Type /Catalog /Pages 2 0 R >>", b"", b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"]
    kids = []
    for text in pages:
        shown = [b"(" + re.sub(rb"([()\\])", rb"\\\1", x.encode("latin-1", "replace")) + b") Tj T*" for x in text.split("\n")]
        stream = b"BT /F1 11 Tf 14 TL 50 780 Td " + b" ".join(shown) + b" ET"
        stream = zlib.compress(stream) if packed else stream
        objects.append(b"<< /Length %d %s>>\nstream\n%s\nendstream" % (len(stream), b"/Filter /FlateDecode " if packed else b"", stream))
        kids.append(b"%d 0 R" % (len(objects) + 1))
        objects.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] /Resources << /Font << /F1 3 0 R >> >> /Contents %d 0 R >>" % len(objects))
    objects[1] = b"<< /Type /Pages /Kids [%s] /Count %d >>" % (b" ".join(kids), len(kids))
    out, places = bytearray(b"%PDF-1.4\n"), []
    for i, body in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (i, body)
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    return bytes(out + b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, start))
