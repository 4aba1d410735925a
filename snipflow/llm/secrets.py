"""Secret scan that unwraps encoded layers until nothing new appears.

Three kinds of span are found in a text: ``assign`` (a secret-like name, ``:``
or ``=``, a value of 12 or more characters), ``access`` (an access key id) and
``hex`` (16 or more lower-case hex digits). Each text starts a worklist of
layers. A layer is scanned, then unwrapped: URL escapes, Unicode escapes and
full-width letters, base64 runs, and compressed bytes (gzip, zlib, bz2, xz,
zstandard) that base64 or URL escapes hold. Every new layer carries, for each
of its characters, the range of the original text it came from, so spans found
in any depth are reported in code points of the whole original text. A layer of
the same text and the same places is not taken up again, so cycles end, while
the same content at another place is a layer of its own.

Defined results: a null or empty text has no spans; bytes of a layer that are no
UTF-8 or UTF-16 stay in it as single characters, and decoded bytes without 16
printable ASCII characters in a row (or full-width letters) end there, as no
secret is shorter; a base64 run is read from each of its first four characters, and
goes on over line breaks and indents after lines of 16 or more characters;
compressed bytes may begin anywhere in a run; all members of a compressed
layer are read, up to ``MAX_LAYER`` bytes (a guard against bombs). Layers that this guard
cuts, or that need more memory than the decompressors are given (``XZ_MEMORY``,
``ZSTD_WINDOW``), are counted in ``n_oversized``. Rows with a repeated or null id
are scanned one by one like any other. Other columns are left aside.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import urllib.parse
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from snipflow.llm.common import text_frame

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
NAMES = ("passw", "secret", "token", "apikey", "api_key")   # each match of ASSIGN holds one

URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPED = re.compile(r"%[0-9A-Fa-f]{2}|.", re.DOTALL)
UNICODE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|((?:\\u[0-9A-Fa-f]{4})+)|\\U([0-9A-Fa-f]{8})"
                     r"|((?:\\x[0-9A-Fa-f]{2})+)|([\uFF01-\uFF5E])")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{22,}={0,2}")   # the shortest secret takes 22 characters
# a blob wrapped over lines, indented or not: full lines, then a shorter one
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:\r?\n[ \t]*+[A-Za-z0-9+/_-]{16,}+)*+"
                     r"(?P<short>\r?\n[ \t]*+[A-Za-z0-9+/_-]{1,15}+)?+={0,2}")
BREAK = re.compile(r"[\r\n\t ]+")
MIXED = re.compile(r"(?:%[0-9A-Fa-f]{2}|[A-Za-z0-9_.!~*'()/;:@&=+$,?#-])+")    # percent-encoded bytes, some left as they are
MAGIC = re.compile(rb"\x1f\x8b\x08|x[\x01\x5e\x9c\xda]|BZh[1-9]|\xfd7zXZ\0|\x28\xb5\x2f\xfd")
PLAIN = re.compile(rb"[\x20-\x7e]{16}|\xef[\xbc\xbd]")
WIDE = re.compile(rb"(?:[\x20-\x7e]\0){16}")
CHUNK = 1 << 16
MAX_LAYER = 1 << 26
XZ_MEMORY, ZSTD_WINDOW = 1 << 28, 1 << 27

SCHEMA = ("doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_spans string, "
          "spans string, n_layers bigint, n_oversized bigint")


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of every span of one layer, per kind leftmost first."""
    out = []
    low = text.lower()
    if any(name in low for name in NAMES):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return out


def _decoded(raw: bytes):
    """(text, first byte, byte after) of the characters of UTF-8 bytes, and of UTF-16
    bytes if there are any; only texts that can hold a secret."""
    for codec, at in [("utf-8", 0)] * (PLAIN.search(raw) is not None) + [("utf-16-le", m.start() % 2) for m in WIDE.finditer(raw)][:1]:
        text = raw[at:].decode(codec, "surrogateescape" if codec == "utf-8" else "replace")
        if codec != "utf-8":
            size = np.array([2 + 2 * (ord(c) > 0xFFFF) for c in text], np.int64)
        elif len(text) == len(raw):
            size = np.ones(len(text), np.int64)
        else:
            size = np.array([len(c.encode("utf-8", "surrogateescape")) for c in text], np.int64)
        stop = np.minimum(at + np.cumsum(size), len(raw))
        yield text, np.minimum(at + np.cumsum(size) - size, len(raw) - 1), stop


def _decompressor(raw: bytes):
    if raw[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if raw[:1] == b"\x78" and len(raw) > 1 and int.from_bytes(raw[:2], "big") % 31 == 0:
        return zlib.decompressobj(15)
    if raw[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if raw[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor(memlimit=XZ_MEMORY)
    if raw[:4] == b"\x28\xb5\x2f\xfd":
        import zstandard
        return zstandard.ZstdDecompressor(max_window_size=ZSTD_WINDOW)
    return None


def _inflate(raw: bytes, limit: int) -> tuple[bytes | None, bool, int]:
    """Content of all members of compressed bytes, whether the limit cut it and how
    many bytes they take; None if not compressed. Damaged bytes give what comes
    before the damage."""
    out, at, refused = bytearray(), 0, False
    try:
        while (d := _decompressor(raw[at:at + 8])) is not None and len(out) <= limit:
            if hasattr(d, "stream_reader"):
                with d.stream_reader(raw[at:], read_across_frames=True) as r:
                    while len(out) <= limit and (part := r.read(min(CHUNK, limit + 1 - len(out)))):
                        out += part
                at = len(raw)
                break
            rest = b""
            while not d.eof and len(out) <= limit:
                data = rest or raw[at:at + CHUNK]
                if not data and not hasattr(d, "needs_input"):
                    break
                if not rest:
                    at += len(data)
                part = d.decompress(data, limit + 1 - len(out))
                out += part
                rest = getattr(d, "unconsumed_tail", b"")
                if not part and not data:
                    break
            if not d.eof:
                break
            at -= len(d.unused_data)
            while raw[at:at + 1] == b"\0":     # padding between members
                at += 1
    except (zlib.error, OSError, EOFError, ValueError, lzma.LZMAError, MemoryError) as exc:
        refused, at = _refused(exc), len(raw)
    except Exception as exc:  # zstandard has its own error class
        if not (type(exc).__module__.startswith(("zstandard", "backend_c")) or type(exc).__name__ == "ZstdError"):
            raise
        refused, at = _refused(exc), len(raw)
    return (bytes(out[:limit]) if out else None), refused or len(out) > limit, at


def _refused(exc: Exception) -> bool:
    """Whether a decompressor gave up for the memory it would need."""
    return isinstance(exc, MemoryError) or "emory" in str(exc)


class _Layer:
    """A text and, per character, the range of the original text behind it."""

    __slots__ = ("text", "start", "end")

    def __init__(self, text, start=None, end=None):
        self.text = text
        self.start = np.arange(len(text)) if start is None else start
        self.end = self.start + 1 if end is None else end


def _rewrite(layer: _Layer, pieces) -> _Layer:
    """A layer with ranges replaced: pieces are (begin, stop, [(char, from, to)])."""
    text, starts, ends, at = [], [], [], 0
    for begin, stop, chars in pieces:
        text.append(layer.text[at:begin])
        starts.append(layer.start[at:begin])
        ends.append(layer.end[at:begin])
        text.append("".join(c for c, _, _ in chars))
        starts.append(np.array([layer.start[a] for _, a, _ in chars], np.int64))
        ends.append(np.array([layer.end[b - 1] for _, _, b in chars], np.int64))
        at = stop
    text.append(layer.text[at:])
    return _Layer("".join(text), np.concatenate([*starts, layer.start[at:]]),
                  np.concatenate([*ends, layer.end[at:]]))


def _chars(raw: bytes, at: int, width: int):
    """Characters of escaped bytes with the range of the escapes; bytes that are
    no UTF-8 stand for the code point of the same number."""
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:
        return [(chr(v), at + i * width, at + (i + 1) * width) for i, v in enumerate(raw)]
    out, k = [], 0
    for c in text:
        n = len(c.encode("utf-8"))
        out.append((c, at + k * width, at + (k + n) * width))
        k += n
    return out


def _unicode_piece(m: re.Match):
    if m[1] is not None or m[3] is not None:
        code = int(m[1] or m[3], 16)
        c = chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "\ufffd"
        return m.start(), m.end(), [(c, m.start(), m.end())]
    if m[2] is not None:
        units = [int(m[2][i + 2:i + 6], 16) for i in range(0, len(m[2]), 6)]
        chars, i = [], 0
        while i < len(units):
            a = m.start() + 6 * i
            if 0xD800 <= units[i] < 0xDC00 and i + 1 < len(units) and 0xDC00 <= units[i + 1] < 0xE000:
                chars.append((chr(0x10000 + ((units[i] - 0xD800) << 10) + units[i + 1] - 0xDC00), a, a + 12))
                i += 2
            else:
                chars.append((chr(units[i]) if not 0xD800 <= units[i] < 0xE000 else "\ufffd", a, a + 6))
                i += 1
        return m.start(), m.end(), chars
    if m[4] is not None:
        return m.start(), m.end(), _chars(bytes.fromhex(m[4].replace("\\x", "")), m.start(), 4)
    return m.start(), m.end(), [(chr(ord(m[5]) - 0xFEE0), m.start(), m.end())]


def unwrap(text: str, limit: int = MAX_LAYER):
    """Spans of all layers in original code points, number of layers, cut layers."""
    spans, work, seen, cut = set(), [], set(), 0
    seen_bytes: set[tuple] = set()

    def push(layer):
        key = hashlib.blake2b(layer.text.encode("utf-8", "surrogatepass"), digest_size=16)
        key.update(layer.start)
        key.update(layer.end)
        if layer.text and key.digest() not in seen:
            seen.add(key.digest())
            work.append(layer)

    def push_bytes(raw, place):
        """Follow compressed bytes down; all of their content stands for the whole blob,
        whose place in the original ``place`` gives from its first and last byte."""
        nonlocal cut
        for m in MAGIC.finditer(raw):
            inner, over, used = _inflate(raw[m.start():], limit)
            cut += over
            if inner is None:
                continue
            where = place(m.start(), m.start() + used)
            todo = [inner]
            while todo:
                inner = todo.pop()
                key = (hashlib.blake2b(inner, digest_size=16).digest(), *where)
                if key in seen_bytes:
                    continue
                seen_bytes.add(key)
                deeper, over, _ = _inflate(inner, limit)
                cut += over
                if deeper is not None:
                    todo.append(deeper)
                for got, _, _ in _decoded(inner):
                    push(_Layer(got, np.full(len(got), where[0]), np.full(len(got), where[1])))

    push(_Layer(text))
    while work:
        layer = work.pop()
        spans.update((int(layer.start[s]), k, int(layer.end[e - 1])) for s, k, e in scan(layer.text))
        t = layer.text
        if "%" in t:
            pieces = []
            for m in URL.finditer(t):
                raw = bytes.fromhex(m[0].replace("%", ""))
                pieces.append((m.start(), m.end(), _chars(raw, m.start(), 3)))
            if pieces:
                push(_rewrite(layer, pieces))
            for m in MIXED.finditer(t):
                if "%" not in m[0] or len(m[0]) < 16:
                    continue
                units = [(u.start(), u.end()) for u in ESCAPED.finditer(t, m.start(), m.end())]
                for run in {m[0], m[0].replace("+", " ")}:
                    push_bytes(urllib.parse.unquote_to_bytes(run),
                               lambda a, b: (int(layer.start[units[a][0]]), int(layer.end[units[b - 1][1] - 1])))
        if "\\" in t or not t.isascii():
            pieces = [_unicode_piece(m) for m in UNICODE.finditer(t)]
            if pieces:
                push(_rewrite(layer, pieces))
        for run, at in _base64_runs(t):
            whole, end = run.rstrip("=").translate({45: 43, 95: 47}), int(at[-1]) + 1
            for skip in range(4):
                run = whole[skip:]
                run = run[:len(run) - 1] if len(run) % 4 == 1 else run
                raw = base64.b64decode(run + "=" * (-len(run) % 4))
                first = lambda x: at[skip + x // 3 * 4]
                last = lambda y: at[np.minimum(skip + (y - 1) // 3 * 4 + 3, len(at) - 1)]
                push_bytes(raw, lambda a, b: (int(layer.start[first(a)]),
                                              int(layer.end[end - 1 if b >= len(raw) else last(b)])))
                for got, x, y in _decoded(raw):
                    push(_Layer(got, layer.start[first(x)], layer.end[last(y)]))
    return spans, len(seen), cut


def _base64_runs(t: str):
    """Base64 runs of a layer with the place of each character: those on one line, then
    those wrapped over lines (with their shorter last line and, as that may be a word
    that follows, without it)."""
    for m in BASE64.finditer(t):
        yield m[0], np.arange(m.start(), m.end())
    if "\n" not in t:
        return
    for m in WRAPPED.finditer(t):
        for stop in {m.end(), m.start("short") if m["short"] else m.end()}:
            part = t[m.start():stop]
            if "\n" not in part:
                continue
            inside = np.ones(len(part), bool)
            for b in BREAK.finditer(part):
                inside[b.start():b.end()] = False
            yield BREAK.sub("", part), m.start() + np.flatnonzero(inside)


def _line(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def _encoded(text: str) -> bool:
    return ("%" in text or "\\" in text or not text.isascii() or BASE64.search(text) is not None
            or any("\n" in m[0] for m in WRAPPED.finditer(text)))


def _scan_batches(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 256):       # bounded number of Python strings at a time
            part = batch.slice(at, 256)
            rows = []
            for doc, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist()):
                base = scan(text)
                counts = [sum(1 for s in base if s[1] == k) for k in range(3)]
                extra, layers, cut = unwrap(text) if _encoded(text) else (set(base), 1, 0)
                rows.append((doc, *counts, _line(base), _line(extra | set(base)), layers, cut))
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.string() if i in (4, 5) else pa.int64()) for i, c in enumerate(cols)],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_spans", "spans", "n_layers", "n_oversized"])


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: base counts, base spans, spans of all layers."""
    return text_frame(df, id_col, text_col).mapInArrow(_scan_batches, SCHEMA)
