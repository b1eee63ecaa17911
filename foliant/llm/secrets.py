"""Secret scans with a recursive decoding worklist.

A text is scanned for assignments, access keys and hex keys. Then its layers are unwrapped: percent codes,
Unicode escapes and character references in place; base64 runs, and what is compressed in them, as texts of
their own. Each new layer is scanned and unwrapped in turn until there is none left. A layer is known by its
content and the part of the text that it came from; one that was seen before (a cycle, or two ways to one layer)
isn't taken again. Escapes within escapes make a layer a pass, ``DEEP`` times; what is nested deeper is decoded to its end in one walk, so the time
for any nesting is in proportion to the text. (A match that uses the digits of an escape which is itself nested deeper than that, and goes with it, isn't
found.) What a layer holds is mapped to the whole text: through in-place codes to the characters
that the match was decoded from, through base64 to the whole run.

A base64 run is decoded at each of its four alignments, by itself and joined with the runs of the lines around it, so a
layer is found behind letters that aren't part of it. Where not all bytes are text, the stretches of ASCII among them are layers (all that
a pattern can match is ASCII), mapped to the characters that they were decoded from. Compressed streams are looked for at every byte, and
unpacked member after member as far as they are sound, and so is what they hold, to any depth: in a run at one alignment each content is unpacked once, from the
first place that leads to it, as all that comes from a place reaches to the run's end.

A layer that unpacks to more than ``MOST_BYTES`` isn't held whole: it is scanned to its end in overlapping blocks and counted in
``n_refused``, and ``mask_secrets`` masks all that it comes from, as a layer in it that is longer than the overlap may be cut. The time is that of what
it unpacks to. Work is a narrow map, a text at a time.

Null and empty texts have no spans. Equal rows give equal results. An empty table gives an empty result. Other
columns aren't read by ``find_secrets`` and are kept by ``mask_secrets``.
"""

from __future__ import annotations

import binascii
import bz2
import hashlib
import html
import lzma
import re
import zlib
from bisect import bisect_right
from collections import deque
from collections.abc import Callable, Iterator
from itertools import accumulate, pairwise

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.session import released, ship, spread

MOST_BYTES = 64 << 20
KINDS = ("assign", "access", "hex")
#: What a secret looks like.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
NAMES = ("passw", "secret", "token", "api")

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\u\{[0-9A-Fa-f]{1,6}\}|\\x[0-9A-Fa-f]{2})+|&(?:\#[0-9]{1,7}|\#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
#: The shortest secret, a name, a sign and eight characters, makes nineteen characters of base64.
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{19,}={0,2}")
#: One escape that ends where a text does, and what it can end with; none is longer than ``LONGEST_UNIT``.
UNIT = r"%[0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\u\{[0-9A-Fa-f]{1,6}\}|\\x[0-9A-Fa-f]{2}|&(?:\#[0-9]{1,7}|\#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"
ANY_UNIT, LAST_UNIT = re.compile(UNIT), re.compile(f"(?:{UNIT})\\Z")
UNIT_ENDS, LONGEST_UNIT = frozenset("0123456789abcdefABCDEF;}"), 34
#: Passes of escapes within escapes that each make a layer; what is nested deeper is decoded to its end in one more.
DEEP = 8
LETTERS = re.compile(r"[A-Za-z0-9+/_-]+")
#: Base64 over several lines.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:[ \t]*+(?:\r\n?|\n)[ \t]*+[A-Za-z0-9+/_-]++)+={0,2}")
#: What a pattern can match in bytes that aren't all text: fourteen characters of ASCII at least, the shortest secret.
STRETCH = re.compile(rb"[\t\n\r\x20-\x7e]{14,}")
#: How gzip, zlib, bzip2, xz and Zstandard begin.
MAGIC = re.compile(rb"\x1f\x8b\x08|x[\x01\x5e\x9c\xda]|BZh[1-9](?:1AY&SY|\x17rE8P\x90)|\xfd7zXZ\0|\x28\xb5\x2f\xfd")
LONGEST_MAGIC = 10
#: Large layers, each in the one before, that are opened: reading one more opens all before it again.
MOST_LARGE = 100
#: Bytes of a large layer that are scanned at once, and that each scan has in common with the one before.
BLOCK, OVERLAP = 4 << 20, 1 << 20

Span = tuple[int, int, str]


def scan(text: str) -> list[Span]:
    """(start, end, kind) of each kind's matches, leftmost first, without overlaps in a kind."""
    found: list[Span] = []
    low = text.lower()
    if any(x in low for x in NAMES):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=_order)


def _order(s: Span) -> tuple:
    return s[0], KINDS.index(s[2]), s[1]


class Layer:
    """A text and how its places map to the whole text: ``at[i]`` is where piece i begins here; ``to[i]`` says where it came
    from and whether its characters map one to one."""

    __slots__ = ("at", "depth", "text", "to")

    def __init__(self, text: str, at: list[int], to: list[tuple[int, int, bool]], depth: int = 0):
        self.text, self.at, self.to, self.depth = text, at, to, depth

    def origin(self, start: int, end: int) -> tuple[int, int]:
        i, j = bisect_right(self.at, start) - 1, bisect_right(self.at, max(start, end - 1)) - 1
        a, b, direct = self.to[i]
        first = a + start - self.at[i] if direct else a
        a, b, direct = self.to[j]
        return first, a + end - self.at[j] if direct else b


class _Rewrite:
    """A layer in the making, out of another one's pieces in their order."""

    def __init__(self, layer: Layer):
        self.layer, self.parts, self.at, self.to, self.n = layer, [], [], [], 0

    def put(self, piece: str, start: int, end: int, direct: bool) -> None:
        """``piece`` stands for the old layer's ``start`` to ``end``; if ``direct``, it is that text."""
        layer = self.layer
        if not piece:
            return
        if not direct:
            self.parts.append(piece)
            self.at.append(self.n)
            self.to.append((*layer.origin(start, end), False))
            self.n += len(piece)
            return
        k = bisect_right(layer.at, start) - 1  # follow the pieces of the old layer, so that places keep mapping one to one
        while start < end:
            stop = min(end, layer.at[k + 1]) if k + 1 < len(layer.at) else end
            own = piece[: stop - start]
            self.parts.append(own)
            self.at.append(self.n)
            a, b, one = layer.to[k]
            self.to.append((a + start - layer.at[k], a + stop - layer.at[k], True) if one else (a, b, False))
            self.n, piece, start, k = self.n + len(own), piece[stop - start :], stop, k + 1

    def done(self) -> Layer:
        return Layer("".join(self.parts), self.at or [0], self.to or [(0, 0, False)], self.layer.depth + 1)


def _in_place(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """The layer with each match decoded once, or None if nothing changes."""
    new, last, changed = _Rewrite(layer), 0, False
    for m in pattern.finditer(layer.text):
        units = decode(m[0])
        if units is None:
            continue
        changed = True
        new.put(layer.text[last : m.start()], last, m.start(), True)
        place = m.start()
        for piece, used in units:
            new.put(piece, place, place + used, False)
            place += used
        last = m.end()
    if not changed:
        return None
    new.put(layer.text[last:], last, len(layer.text), True)
    return new.done()


def _innermost(layer: Layer) -> Layer:
    """The layer with its escapes decoded until none is left, in one walk: each escape is decoded when its last character comes, and what it
    gives may be part of the next."""
    text, new, n = layer.text, _Rewrite(layer), len(layer.text)
    tail: list[tuple[str, int, int, int]] = []  # characters that may still be part of an escape: start, end, and the byte if it is but that

    def settle(keep: int) -> None:
        for c, a, b, byte in tail[: max(0, len(tail) - keep)]:
            new.put("\ufffd" if byte >= 0 else c, a, b, byte == -1)
        del tail[: max(0, len(tail) - keep)]

    def shrink() -> bool:
        """Decodes the escape or the UTF-8 sequence that the tail ends in, if there is one."""
        if tail[-1][3] >= 0:
            k = next((k for k in range(1, min(4, len(tail)) + 1) if tail[-k][3] < 0x80 or tail[-k][3] >= 0xC0), 0)
            raw = bytes(x[3] for x in tail[-k:]) if k and all(x[3] >= 0 for x in tail[-k:]) else b""
            try:
                made = raw.decode()
            except UnicodeDecodeError:
                return False
            if not made:
                return False
        else:
            if tail[-1][0] not in UNIT_ENDS or not (m := LAST_UNIT.search("".join(x[0] for x in tail[-LONGEST_UNIT:]))):
                return False
            k, unit = len(m[0]), m[0]
            if unit[0] == "%":
                byte = int(unit[1:], 16)
                made = chr(byte) if byte < 0x80 else ""
                if not made:
                    tail[-k:] = [("\0", tail[-k][1], tail[-1][2], byte)]
                    return True
            else:
                units = _escape(unit)
                if units is None:
                    return False
                made = "".join(c for c, _ in units)
        a, b = tail[-k][1], tail[-1][2]
        tail[-k:] = [(c, a, b, -2) for c in made]
        return True

    at = hot = 0
    while at < n:
        if not hot:  # nothing decoded is near: on to the next escape
            m = next((m for m in ANY_UNIT.finditer(text, max(0, at - LONGEST_UNIT)) if m.end() > at), None)
            stop = max(at, (m.end() if m else n) - 2 * LONGEST_UNIT)
            if not m or m.start() >= at:
                settle(0)
            new.put(text[at:stop], at, stop, True)
            at, hot = stop, (m.end() - stop) if m else n - stop
            continue
        tail.append((text[at], at, at + 1, -1))
        at, hot = at + 1, hot - 1
        while tail and shrink():
            hot = 2 * LONGEST_UNIT
        if len(tail) > 4 * LONGEST_UNIT:
            settle(2 * LONGEST_UNIT)
    settle(0)
    return new.done()


def _percent(run: str) -> list[tuple[str, int]]:
    """Characters of a run of percent codes and how many places each takes; a byte that isn't UTF-8 is a replacement character."""
    text = bytes.fromhex(run.replace("%", "")).decode("utf-8", "surrogateescape")
    return [("\ufffd", 3) if 0xDC80 <= ord(c) <= 0xDCFF else (c, 3 * len(c.encode())) for c in text]


def _escape(run: str) -> list[tuple[str, int]] | None:
    if run[0] == "&":
        text = html.unescape(run)
        return None if text == run else [(text, len(run))]
    out, at = [], 0
    for m in re.finditer(r"\\u\{([0-9A-Fa-f]+)\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})", run):
        code = int(m[1] or m[2] or m[3] or m[4], 16)
        if code > 0x10FFFF:
            code = 0xFFFD
        if 0xDC00 <= code < 0xE000 and out and 0xD800 <= ord(out[-1][0]) < 0xDC00:
            high = out.pop()
            out.append((chr(0x10000 + ((ord(high[0]) - 0xD800) << 10) + code - 0xDC00), high[1] + len(m[0])))
        else:
            out.append((chr(code), len(m[0])))
        at = m.end()
    if at != len(run):
        return None
    return [("\ufffd" if 0xD800 <= ord(c) < 0xE000 else c, n) for c, n in out]


def _pieces(raw: bytes | memoryview) -> Iterator[bytes]:
    return (bytes(raw[a : a + 4096]) for a in range(0, len(raw), 4096))


def _unpacked(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """What a compressed stream unpacks to, in blocks, member after member, as far as it is sound."""
    most, head = min(BLOCK, MOST_BYTES), b""
    while len(head) < LONGEST_MAGIC and (more := next(chunks, b"")):
        head += more
    try:
        if head[:4] == b"\x28\xb5\x2f\xfd":
            reader = zstandard.ZstdDecompressor().stream_reader(_Source(head, chunks), read_across_frames=True)
            while out := reader.read(most):
                yield out
            return
        while MAGIC.match(head):
            d = bz2.BZ2Decompressor() if head[:3] == b"BZh" else lzma.LZMADecompressor() if head[:1] == b"\xfd" else zlib.decompressobj(47)
            data = head
            while not d.eof:
                out = d.decompress(data, most)
                if out:
                    yield out
                data = getattr(d, "unconsumed_tail", b"")
                if not d.eof and not data and getattr(d, "needs_input", len(out) < most) and not (data := next(chunks, b"")):
                    return
            head = d.unused_data
            while len(head) < LONGEST_MAGIC and (more := next(chunks, b"")):
                head += more
    except (zlib.error, OSError, EOFError, lzma.LZMAError, zstandard.ZstdError):
        return


class _Source:
    """Chunks as what ``zstandard`` reads from."""

    def __init__(self, head: bytes, chunks: Iterator[bytes]):
        self.held, self.chunks = head, chunks

    def read(self, n: int = -1) -> bytes:
        data = self.held or next(self.chunks, b"")
        out, self.held = (data, b"") if n < 0 else (data[:n], data[n:])
        return out


_STANDARD = bytes.maketrans(b"-_", b"+/")


class Run:
    """Base64 in a layer: its characters without what is between lines, and where each of them is."""

    __slots__ = ("at", "body", "end", "layer", "to")

    def __init__(self, layer: Layer, m: re.Match, wrapped: bool):
        self.layer, self.end = layer, m.end()
        parts = [(x.start(), x[0]) for x in LETTERS.finditer(m[0])] if wrapped else [(0, m[0].rstrip("="))]
        self.body = "".join(x for _, x in parts)
        self.to = [m.start() + i for i, _ in parts]
        self.at = list(accumulate((len(x) for _, x in parts[:-1]), initial=0))

    def place(self, i: int) -> int:
        k = bisect_right(self.at, i) - 1
        return self.to[k] + i - self.at[k]

    def origin(self, a: int, b: int) -> tuple[int, int]:
        """Where characters ``a`` to ``b`` come from; the last ones with the signs that fill them up."""
        return self.layer.origin(self.place(a), self.end if b >= len(self.body) else self.place(b - 1) + 1)

    def decoded(self, shift: int) -> bytes:
        body = self.body[shift:]
        body = body[: len(body) - (len(body) % 4 == 1)]
        return binascii.a2b_base64(body.encode().translate(_STANDARD) + b"=" * (-len(body) % 4))

    def part(self, shift: int, m: re.Match) -> Layer:
        """A stretch of what was decoded; each three bytes map to their four characters."""
        at, to = [], []
        for g in range(m.start() // 3, (m.end() - 1) // 3 + 1):
            at.append(max(0, 3 * g - m.start()))
            to.append((*self.origin(shift + 4 * g, min(shift + 4 * g + 4, len(self.body))), False))
        return Layer(m[0].decode("ascii"), at, to)


def _found(text: str) -> tuple[list[Span], list[Span], int, set[tuple[int, int]], int]:
    """``find``, with where the large layers come from before their number."""
    base = scan(text)
    spans = set(base)
    seen: set[tuple] = set()
    work: deque[Layer] = deque([Layer(text, [0], [(0, len(text), True)])])
    large: set[tuple[int, int]] = set()
    layers = n_large = 0

    def push(layer: Layer, origin: tuple[int, int]) -> None:
        nonlocal layers
        mark = (origin, len(layer.text), hashlib.blake2b(layer.text.encode("utf-8", "surrogatepass"), digest_size=16).digest())
        if mark in seen:
            return
        seen.add(mark)
        layers += 1
        for start, end, kind in scan(layer.text):
            spans.add((*layer.origin(start, end), kind))
        work.append(layer)

    def push_whole(raw: bytes, origin: tuple[int, int]) -> None:
        """A layer of its own, or its stretches of text if not all of it is text."""
        try:
            inner = raw.decode()
        except UnicodeDecodeError:
            for m in STRETCH.finditer(raw):
                push(Layer(m[0].decode("ascii"), [0], [(*origin, False)]), origin)
        else:
            if inner:
                push(Layer(inner, [0], [(*origin, False)]), origin)

    def unpack(stream: Callable[[], Iterator[bytes]], origin: tuple[int, int], seen: set[bytes]) -> None:
        """What a compressed stream holds, and what is compressed in that, however deep, until it comes round or to what another stream of the run held.
        A large stream is opened again for what is in it."""
        nonlocal n_large
        again = 0
        while True:
            held, blocks = bytearray(), _unpacked(stream())
            for block in blocks:
                held += block
                if len(held) > MOST_BYTES:
                    break
            whole, mark = len(held) <= MOST_BYTES, hashlib.blake2b(held, digest_size=16).digest()
            if mark in seen:
                return
            seen.add(mark)
            inside = MAGIC.match(held) is not None
            if whole:
                raw = bytes(held)
                push_whole(raw, origin)
                if not inside:
                    return
                stream = lambda raw=raw: _pieces(raw)
                continue
            n_large += 1
            large.add(origin)
            step, tail = min(BLOCK, MOST_BYTES), b""
            first, held = [bytes(held[a : a + step]) for a in range(0, len(held), step)], bytearray()
            while block := first.pop(0) if first else next(blocks, b""):
                part = tail + block
                for m in STRETCH.finditer(part):
                    push(Layer(m[0].decode("ascii"), [0], [(*origin, False)]), origin)
                drain()  # so that only one block is held
                tail = part[-OVERLAP:]
            again += 1
            if not inside or again > MOST_LARGE:
                return
            stream = lambda outer=stream: _unpacked(outer())

    def unwrap(run: Run, wrapped: bool) -> None:
        for shift in range(4):
            raw, seen = run.decoded(shift), set()
            if shift == 0 and not wrapped and _is_text(raw) and len(run.body) % 4 != 1:
                push_whole(raw, run.origin(0, len(run.body)))
            else:
                for m in STRETCH.finditer(raw):
                    push(run.part(shift, m), run.origin(shift, len(run.body)))
            for m in MAGIC.finditer(raw):
                unpack(lambda raw=raw, at=m.start(): _pieces(memoryview(raw)[at:]), run.origin(shift + 4 * (m.start() // 3), len(run.body)), seen)

    def drain() -> None:
        while work:
            layer = work.popleft()
            rewritten: list[Layer | None] = []
            if layer.depth < DEEP:
                if "%" in layer.text:
                    rewritten.append(_in_place(layer, PERCENT, _percent))
                if "\\" in layer.text or "&" in layer.text:
                    rewritten.append(_in_place(layer, ESCAPE, _escape))
            elif layer.depth == DEEP and ANY_UNIT.search(layer.text):
                rewritten.append(_innermost(layer))
            for new in rewritten:
                if new:
                    push(new, (0, len(text)) if layer.to[0][2] or len(layer.to) > 1 else layer.to[0][:2])
            for m in BASE64.finditer(layer.text):
                unwrap(Run(layer, m, False), False)
            if "\n" in layer.text or "\r" in layer.text:
                for m in WRAPPED.finditer(layer.text):
                    if len(m[0]) >= 20 and len((run := Run(layer, m, True)).body) >= 19:
                        unwrap(run, True)

    drain()
    return base, sorted(spans, key=_order), layers, large, n_large


def _is_text(raw: bytes) -> bool:
    try:
        raw.decode()
    except UnicodeDecodeError:
        return False
    return True


def find(text: str) -> tuple[list[Span], list[Span], int, int]:
    """Base spans, all spans (both in order), layers unwrapped, and layers too large to be held whole."""
    base, spans, layers, _, n_large = _found(text)
    return base, spans, layers, n_large


def _listed(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


RESULT = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_layers long, n_refused long"


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` with the number of base matches of each kind, a digest of the base spans, all spans, and layers."""
    ship(docs.sparkSession)
    rows = spread(docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("__text")))
    kind = rows.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for value in batch.column(1):
                base, spans, layers, refused = find(value.as_py())
                kinds = [s[2] for s in base]
                for column, x in zip(
                    out,
                    (*map(kinds.count, KINDS), hashlib.sha256(_listed(base).encode()).hexdigest(), _listed(spans), layers, refused),
                    strict=True
                ):
                    column.append(x)
            types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, t) for x, t in zip(out, types, strict=True))],
                names=[key, "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_layers", "n_refused"]
            )

    return rows.mapInArrow(released(run), f"`{key}` {kind}, {RESULT}")


def masked(whole: str | None, mark: str) -> str | None:
    """A text with every span masked, and what a layer too large to be held comes from; overlapping spans are masked as one."""
    if not whole:
        return whole
    _, found, _, large, _ = _found(whole)
    spans = sorted([*found, *((a, b, "large") for a, b in large)], key=lambda s: s[:2])
    if not spans:
        return whole
    joined: list[list[int]] = []
    for start, end, _ in spans:
        if joined and start < joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], end)
        else:
            joined.append([start, end])
    cuts = [0, *(x for s in joined for x in s), len(whole)]
    return mark.join(whole[a:b] for a, b in list(pairwise(cuts))[::2])


def mask_secrets(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of its text replaced by ``mark``, and what a layer too large to be held comes from; overlapping spans are masked as one."""
    ship(docs.sparkSession)

    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = pa.array([masked(v.as_py(), mark) for v in batch.column(place)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:place], new, *batch.columns[place + 1 :]], names=batch.schema.names)

    return spread(docs).mapInArrow(released(run), docs.schema)
