"""Secret scans with a recursive decoding worklist.

A text is scanned for three kinds of secret. Then every place in it that is
encoded, by percent signs, Unicode escapes (of programs, URLs or character
references by number) or base64, is unwrapped into a layer
of its own, which is scanned and unwrapped in turn until nothing new comes up.
What base64 holds may be compressed, any number of times over; it is inflated
until it is no longer. A layer whose content was met before at the same place is
not entered again, so cycles end, and neither is compressed data within itself.
Each layer knows for each of its characters which characters of the text it
came from; a secret's span is mapped back through all layers.

Percent and Unicode layers are the whole parent with its escapes decoded, so
secrets that they only partly hide are found as well, and only secrets that
touch an escape are new. Base64 layers are one token of the parent, in either
alphabet or both, which may be wrapped over lines or stand after a path. Where a
token begins and ends among neighbouring words and lines is not certain, so
several readings are tried. All members of compressed data are read.

Cases: a null text is empty and has no secrets; texts are scanned whole,
however long; decoded data that is no UTF-8 text and does not decompress is
dropped, so base64 of other character sets, raw deflate and other archives are
not read, and neither is a token that is glued to a letter. Compressed data is inflated in a stream. Beyond ``WINDOW`` bytes it is
scanned in windows of that size, each of which begins ``OVERLAP`` bytes before
the end of the last, so memory is bounded; all secrets and tokens up to that
length are found whole, and of longer ones a part. Such layers are counted in
``windowed``. Repeated rows are scanned alike; an empty table gives no rows.
Extra columns are not read.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

KINDS = ("assign", "access", "hex")
#: Bytes that are inflated at once.
PIECE = 1 << 20
#: Bytes of decompressed data that are scanned at once, and how far one window reaches into the next.
WINDOW, OVERLAP = 64 << 20, 1 << 20

_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
#: A quick look for what every assignment has before its value.
_KEY = re.compile(r"(?:passw|secret|token|api)", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_DIGIT = re.compile(r"[0-9]")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
#: One Unicode escape: ``\\u0077``, ``\\U00000077``, ``\\u{77}``, ``\\x77``, ``%u0077``, ``&#119;`` or ``&#x77;``.
_UNIT = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|%u([0-9A-Fa-f]{4})|&#[xX]([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
_ESCAPE = re.compile(f"(?:{re.sub(r'\((?!\?)', '(?:', _UNIT.pattern)})+")
#: What every escape starts with.
_MARK = re.compile(r"\\|%u|&#")
#: A run over both alphabets and line breaks, and how parts of it may be read.
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]+(?:[\x20\t]*\r?\n[\x20\t]*[A-Za-z0-9+/_-]+)*={0,2}")
_LINE = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
_PARTS = (re.compile(r"[A-Za-z0-9+/]{16,}={0,2}"), re.compile(r"[A-Za-z0-9_-]{16,}={0,2}"))
#: Where a token may begin after what is not part of it.
_AFTER = re.compile(r"(?<=[/+_-])[A-Za-z0-9]")
#: How base64 of gzip and zlib data starts.
_PACKED = re.compile(r"H4sI|e[A-P]")
_BREAK = re.compile(r"\s+")
#: Base64 of ASCII text or of compressed data mixes cases; prose within a word does not.
_MIXED = re.compile(r"[a-z][A-Z0-9+/_-]*[A-Z]|[A-Z0-9+/_-][a-z]+[A-Z0-9]|[0-9+/_=]")

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Secrets that stand in a text: kind, start, end in code points, by start and then kind."""
    out: list[Span] = []
    if _KEY.search(text):
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return ordered(out)


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(set(spans), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


class Layer:
    """A decoded text and, for each of its characters, the range of the document's characters it came from."""

    def __init__(self, text: str, starts: np.ndarray, ends: np.ndarray, fresh: np.ndarray | None):
        self.text, self.starts, self.ends, self.fresh = text, starts, ends, fresh

    @classmethod
    def within(cls, text: str, start: int, end: int) -> Layer:
        """A text all of whose characters came from one range; the arrays are one number each."""
        one = lambda x: np.broadcast_to(np.int64(x), len(text))
        return cls(text, one(start), one(end), None)

    def key(self) -> bytes:
        """A digest of its text and place."""
        digest = hashlib.blake2b(self.text.encode("utf-8", "surrogatepass"), digest_size=16)
        for places in (self.starts, self.ends):
            digest.update(places[:1].tobytes() if places.strides == (0,) else places.tobytes())
        return digest.digest()

    def spans(self) -> list[Span]:
        """Its secrets, as spans of the document; in a partly decoded layer only those that touch what was decoded."""
        out = []
        for kind, a, b in base_spans(self.text):
            if self.fresh is None or self.fresh[a:b].any():
                out.append((kind, int(self.starts[a:b].min()), int(self.ends[a:b].max())))
        return out


def _escaped(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """The layer with all escapes of one kind decoded in place."""
    pieces, starts, ends, fresh, at = [], [], [], [], 0
    for m in pattern.finditer(layer.text):
        for text, a, b in decode(m):
            pieces += [layer.text[at:a], text]
            starts += [layer.starts[at:a], np.full(len(text), layer.starts[a], np.int64)]
            ends += [layer.ends[at:a], np.full(len(text), layer.ends[b - 1], np.int64)]
            fresh += [np.zeros(a - at, bool), np.ones(len(text), bool)]
            at = b
    if not pieces:
        return None
    pieces.append(layer.text[at:])
    join = lambda x, rest: np.concatenate([*x, rest])
    return Layer("".join(pieces), join(starts, layer.starts[at:]), join(ends, layer.ends[at:]), join(fresh, np.zeros(len(layer.text) - at, bool)))


def _percent(m: re.Match) -> list[tuple[str, int, int]]:
    """Characters of a run of percent escapes; bytes that are no UTF-8 stay as they are."""
    raw = bytes.fromhex(m.group().replace("%", ""))
    out, k = [], 0
    while k < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append((raw[k : k + n].decode(), m.start() + 3 * k, m.start() + 3 * (k + n)))
                k += n
                break
            except UnicodeDecodeError:
                pass
        else:
            k += 1
    return out


def _unicode(m: re.Match) -> list[tuple[str, int, int]]:
    """Characters of a run of Unicode escapes; surrogate pairs are one character, lone ones and numbers of no character stay."""
    units = [(int(y[7]) if y[7] else int(next(filter(None, y.groups())), 16), *y.span()) for y in _UNIT.finditer(m.group())]
    units = [(c, m.start() + a, m.start() + b) for c, a, b in units]
    out, k = [], 0
    while k < len(units):
        c, a, b = units[k]
        if 0xD800 <= c < 0xDC00 and k + 1 < len(units) and 0xDC00 <= units[k + 1][0] < 0xE000:
            out.append((chr(0x10000 + ((c - 0xD800) << 10) + units[k + 1][0] - 0xDC00), a, units[k + 1][2]))
            k += 2
            continue
        if not 0xD800 <= c < 0xE000 and c < 0x110000:
            out.append((chr(c), a, b))
        k += 1
    return out


def _is_packed(head: bytes) -> bool:
    """Whether data starts as gzip or zlib data does."""
    return head[:2] == b"\x1f\x8b" or (head[:1] == b"\x78" and len(head) > 2 and int.from_bytes(head[:2], "big") % 31 == 0)


def _inflate(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """What gzip or zlib data holds, all members, in pieces; ends where the data does or is broken."""
    engine, raw = zlib.decompressobj(47), b""
    while True:
        if len(raw) < 3:
            raw += next(pieces, b"")
        if not raw:
            return
        try:
            out = engine.decompress(raw, PIECE)
        except zlib.error:
            return
        if out:
            yield out
        if engine.eof:
            raw, engine = engine.unused_data, zlib.decompressobj(47)
            if len(raw) < 3:
                raw += next(pieces, b"")
            raw = raw.lstrip(b"\0")
            if not (raw[:2] == b"\x1f\x8b" or raw[:1] == b"\x78"):
                return
        else:
            raw = engine.unconsumed_tail or next(pieces, b"")


def _unpacked(raw: bytes) -> Iterator[bytes]:
    """Data inflated until it is no longer compressed, in pieces; nothing if it holds itself."""
    pieces, seen = iter([raw]), set()
    while True:
        first = next(pieces, b"")
        while len(first) < 3 and (more := next(pieces, b"")):
            first += more
        if not _is_packed(first):
            break
        digest = hashlib.blake2b(first, digest_size=16).digest()
        if digest in seen:
            return
        seen.add(digest)
        inner = _inflate(chain([first], pieces))
        head = next(inner, None)
        if head is None:
            break  # it only looked compressed
        pieces = chain([head], inner)
    yield first
    yield from pieces


def _windows(raw: bytes) -> Iterator[tuple[bytes, bool]]:
    """The data that ``raw`` holds, in windows, and whether it has more than one."""
    if not _is_packed(raw):
        yield raw, False
        return
    held, size, several = [], 0, False
    for piece in _unpacked(raw):
        held.append(piece)
        size += len(piece)
        if size > WINDOW:
            whole, several = b"".join(held), True
            yield whole, True
            held = [whole[-OVERLAP:]]
            size = len(held[0])
    yield b"".join(held), several


def _text_of(raw: bytes, part: bool = False) -> str | None:
    """The data as UTF-8; a part of a text may begin and end within a character."""
    try:
        return raw.decode()
    except UnicodeDecodeError as e:
        if part and (e.start < 4 or e.start > len(raw) - 4):
            text = raw.decode(errors="replace")
            return text if text.count("\ufffd") <= 8 else None
        return None


def _bytes_of(token: str) -> bytes | None:
    """What base64 in either alphabet holds, with or without its padding."""
    bare = token.rstrip("=")
    if len(bare) % 4 == 1:
        bare = bare[:-1]
    try:
        return base64.b64decode(bare.replace("-", "+").replace("_", "/") + "=" * (-len(bare) % 4), validate=True)
    except binascii.Error:
        return None


def _begins(text: str, at: int) -> bool:
    """Whether base64 from here on looks like text or compressed data, by its first few characters."""
    raw = _bytes_of(text[at : at + 16])
    return bool(raw) and (_is_packed(raw) or (raw.isascii() and all(c >= 32 or c in b"\t\n\r\x1b" for c in raw)))


def _inflates(text: str, at: int) -> bool:
    """Whether base64 from here on is compressed data, by what its first characters inflate to."""
    raw = _bytes_of(_BREAK.sub("", text[at : at + 128])[:96])
    if not raw or not _is_packed(raw):
        return False
    try:
        zlib.decompressobj(47).decompress(raw, PIECE)
    except zlib.error:
        return False
    return True


def _readings(text: str, first: int, end: int) -> list[tuple[int, int]]:
    """Parts of a run that may be a token, by start, the longest first: the run, its lines
    and blocks of lines of one width, what starts like compressed data, and parts in one alphabet."""
    found = {(first, end)}
    lines = [m.span() for m in _LINE.finditer(text, first, end)]
    if len(lines) > 1:
        found.update((a, end) for a, _ in lines if _PACKED.match(text, a) and _inflates(text, a))
        k = 0
        while k < len(lines):
            last = k
            while last + 1 < len(lines) and lines[last + 1][1] - lines[last + 1][0] == lines[k][1] - lines[k][0]:
                last += 1
            tail = min(last + 1, len(lines) - 1)
            found.update((lines[a][0], lines[b][1]) for a in (max(0, k - 1), k) for b in (last, tail))
            k = last + 1
    for a, b in lines:
        found.add((a, b))
        for pattern in _PARTS:
            found.update(m.span() for m in pattern.finditer(text, a, b))
        # a token behind a path or a word that its alphabet can hold
        found.update((m.start(), e) for m in _AFTER.finditer(text, a, b - 15) if _begins(text, m.start()) for e in {b, end})
    return sorted((x for x in found if x[1] - x[0] >= 16), key=lambda x: (x[0], -x[1]))


def _tokens(layer: Layer) -> Iterator[tuple[str, int, int, bool]]:
    """Texts that base64 tokens of a layer hold, with the token's place; whether it is a window of a longer one."""
    for m in _BASE64.finditer(layer.text):
        if m.end() - m.start() < 16:
            continue
        read = -1
        for a, b in _readings(layer.text, *m.span()):
            if a == read:
                continue  # the start of what was read whole
            token = _BREAK.sub("", layer.text[a:b])
            if not _MIXED.search(token):
                continue
            raw = _bytes_of(token)
            if raw is None:
                continue
            for window, several in _windows(raw):
                text = _text_of(window, several)
                if text and len(text) >= 6:
                    read = a
                    yield text, a, b, several


def scan(text: str | None) -> tuple[list[Span], list[Span], int]:
    """Base spans, all spans, and how many windows of long layers were scanned."""
    text = text or ""
    base = base_spans(text)
    if not _DIGIT.search(text) and "\\" not in text and "%" not in text and "&#" not in text and "+" not in text and "/" not in text and "=" not in text and not re.search(r"[a-z][A-Z]|[_-]", text):
        return base, base, 0  # nothing in it can be encoded
    spans, windowed = list(base), 0
    places = np.arange(len(text), dtype=np.int64)
    seen: set[bytes] = set()

    def enter(layer: Layer) -> bool:
        key = layer.key()
        new = key not in seen
        seen.add(key)
        return new

    def inner(layer: Layer) -> Iterator[Layer]:
        """New layers of a layer, one after the other, so that a long one's windows are never held together."""
        nonlocal windowed
        for mark, pattern, decode in ((_PERCENT, _PERCENT, _percent), (_MARK, _ESCAPE, _unicode)):
            if mark.search(layer.text) and (found := _escaped(layer, pattern, decode)) and enter(found):
                yield found
        for token, a, b, several in _tokens(layer):
            windowed += several
            found = Layer.within(token, int(layer.starts[a:b].min()), int(layer.ends[a:b].max()))
            if enter(found):
                yield found

    root = Layer(text, places, places + 1, None)
    enter(root)
    work = [inner(root)]
    while work:
        found = next(work[-1], None)
        if found is None:
            work.pop()
            continue
        spans += found.spans()
        work.append(inner(found))
    return base, ordered(spans), windowed


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ``doc_id, n_assign, n_access, n_hex, base, spans, windowed``; counts are of base spans."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan(t) for t in batch.column(1).to_pylist()]
            counts = [pa.array([sum(s[0] == kind for s in f[0]) for f in found], pa.int64()) for kind in KINDS]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts, pa.array([joined(f[0]) for f in found], pa.string()), pa.array([joined(f[1]) for f in found], pa.string()), pa.array([f[2] for f in found], pa.int64())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base", "spans", "windowed"],
            )

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base string, spans string, windowed long")
