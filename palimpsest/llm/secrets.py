"""Secret scans with structural confirmation.

Base patterns give assignments, access keys and hex runs. Beyond them,
candidates are reported only once decoded and parsed: signed tokens by their
JSON header and payload and their signature, base64 and hex runs by key
encodings whose nested lengths add up to the end (DER sequences, length-prefixed
key strings, key containers), armoured blocks by their body. Base64 may be
wrapped over lines; armour may have header lines and line ends that are escaped. DER is followed to 12
levels; what nests deeper isn't reported. Every text takes time in proportion to its length: lines of
base64 are decoded once, and where length-prefixed strings lead is remembered.

Spans are (kind, start, end) in code points, end exclusive, sorted by start and
then by kind in the order of ``KINDS``. What parses as a public key is reported
as the structure it is, but ``redact`` leaves it. Null and empty texts have none,
and stay. Texts are scanned whole, however long; repeated rows get a row each, an
empty table an empty result, and other columns are kept by ``redacted`` and
ignored by ``scan``. The scan is one pass without a shuffle.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_right
from itertools import accumulate, zip_longest

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import column, map_texts

BASE_KINDS = ("assign", "access", "hex")
#: Kinds in their order: base ones, then what the structural confirmation adds.
KINDS = (*BASE_KINDS, "token", "armour", "der", "wire")

ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: The runs of 32 and more: a shorter run fails, and none begins inside another.
HEX = re.compile(r"[0-9a-f]{32,}")
WORDS = (b"passw", b"secret", b"token", b"apikey", b"api_key")

TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")
#: Armour is found by its first and last lines; what is between is then judged line by line.
BEGIN = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----")
END = re.compile(r"-----END ([A-Z0-9 ]*PRIVATE KEY)-----")
_LINE_END = re.compile(r"\\[nr]|[\r\n]")
_HEADER = re.compile(r"[A-Za-z-]+: [^\\]+")
_BODY = re.compile(r"[A-Za-z0-9+/=\s]*")
#: A DER sequence in base64 begins with M; a wire string of under 16 MB with AAAA; a key container with b3BlbnNzaC1rZXk.
CODED = re.compile(r"(?<![A-Za-z0-9+/])(?:M[A-Za-z0-9+/]|AAAA|b3BlbnNzaC1rZXk)[A-Za-z0-9+/]{30,}={0,2}")
#: The same over more lines, and what a line holds of it.
WRAPPED = re.compile(r"[A-Za-z0-9+/]+(?:\r?\n[ \t]*[A-Za-z0-9+/]+)+={0,2}")
_PIECE = re.compile(r"[A-Za-z0-9+/]+=*")
#: DER sequences, wire strings and key containers in hex.
HEX_CODED = re.compile(r"(?<![0-9A-Fa-f])(?:30|000000|6[fF]70656[eE]7373682[dD]6[bB])[0-9A-Fa-f]{58,}(?![0-9A-Fa-f])")

CONTAINER = b"openssh-key-v1\0"
#: A key type, the first of a wire key's strings.
KEY_TYPE = re.compile(rb"(ssh-|ecdsa-|sk-)[a-z0-9@.-]+$")
#: Levels of DER that are followed; keys and certificates nest to half of it.
DEPTH = 12
Span = tuple[str, int, int]


def der_element(raw: bytes, at: int, stop: int) -> tuple[int, int, int] | None:
    """(tag, start of the content, its end) of the element at ``at``, if it ends by ``stop``."""
    if at + 2 > stop:
        return None
    tag, n = raw[at], raw[at + 1]
    at += 2
    if n & 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or at + k > stop or raw[at] == 0:
            return None
        n = int.from_bytes(raw[at : at + k], "big")
        at += k
    return (tag, at, at + n) if at + n <= stop else None


def der_fits(raw: bytes, at: int = 0, stop: int | None = None) -> bool:
    """A sequence from ``at`` to ``stop`` with two elements or more, nested sequences and sets filled exactly, an integer or object id among them."""
    seen = set()
    stop = len(raw) if stop is None else stop

    def fill(at: int, stop: int, depth: int) -> int:
        n = 0
        while at < stop:
            e = der_element(raw, at, stop)
            if e is None or depth > DEPTH or e[0] & 0x1F not in (1, 2, 3, 4, 5, 6, 10, 12, 16, 17, 19, 20, 22, 23, 24) and e[0] < 0xA0:
                return -1
            seen.add(e[0])
            if e[0] & 0x20 and fill(e[1], e[2], depth + 1) < 0:
                return -1
            at, n = e[2], n + 1
        return n

    top = der_element(raw, at, stop)
    return top is not None and top[0] == 0x30 and top[2] == stop and stop - at >= 24 and fill(top[1], top[2], 1) >= 2 and bool(seen & {2, 6})


def _string(raw: bytes, at: int) -> int:
    """Where the length-prefixed string at ``at`` ends; -1 if it doesn't fit."""
    stop = at + 4 + int.from_bytes(raw[at : at + 4], "big")
    return stop if at + 4 <= len(raw) and stop <= len(raw) else -1


def _strings_to_end(raw: bytes, at: int, known: dict[int, int]) -> int:
    """How many length-prefixed strings fill the rest from ``at`` on; -1 if they don't end with it. ``known`` holds what was found before."""
    passed = []
    while at != len(raw) and at >= 0 and at not in known:
        passed.append(at)
        at = _string(raw, at)
    n = 0 if at == len(raw) else known.get(at, -1)
    for place in reversed(passed):
        n = n + 1 if n >= 0 else -1
        known[place] = n
    return n


def wire_fits(raw: bytes, at: int = 0, known: dict[int, int] | None = None) -> bool:
    """Length-prefixed strings from ``at`` to the end, two or more, the first naming a key type; or a key container filled to its end."""
    known = {} if known is None else known
    if raw.startswith(CONTAINER, at):
        at += len(CONTAINER)
        for _ in range(3):  # cipher, derivation, its options; then how many keys
            at = _string(raw, at) if at >= 0 else -1
        if at < 0 or at + 4 > len(raw):
            return False
        n = int.from_bytes(raw[at : at + 4], "big")
        at += 4
        if n < 1 or _strings_to_end(raw, at, known) != n + 1:  # public keys, the private part
            return False
        for _ in range(n):
            stop = _string(raw, at)
            if not wire_fits(raw[at + 4 : stop]):
                return False
            at = stop
        return True
    stop = _string(raw, at)
    return stop >= 0 and KEY_TYPE.match(raw, at + 4, stop) is not None and _strings_to_end(raw, at, known) >= 2


def public(raw: bytes) -> bool:
    """Whether what fits as DER or wire strings is a public key: key strings outside a container, a certificate or request, or a key info of an algorithm and a bit string."""
    if raw[:1] != b"\x30":
        return not raw.startswith(CONTAINER)
    top = der_element(raw, 0, len(raw))
    at, tags = top[1], []
    while at < top[2]:
        e = der_element(raw, at, top[2])
        tags.append(e[0])
        at = e[2]
    # private keys begin with a version; encrypted ones are an algorithm and an octet string; a bare pair of integers is a public key
    return tags[:2] == [0x30, 0x03] or tags == [0x30, 0x30, 0x03] or tags == [0x02, 0x02]


def _decoded(text: str, url: bool = False) -> bytes | None:
    text = text.rstrip("=")
    if len(text) % 4 == 1:
        return None
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), altchars=b"-_" if url else None, validate=True)
    except (binascii.Error, ValueError):
        return None


def _json(text: str) -> dict | None:
    raw = _decoded(text, url=True)
    try:
        found = json.loads(raw) if raw else None
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def _signed(head: str, payload: str, signature: str) -> bool:
    """A header that names an algorithm, a JSON payload (encrypted ones are bytes), and a signature unless the algorithm is none."""
    found = _json(head)
    if found is None or not isinstance(found.get("alg"), str):
        return False
    if "enc" in found:
        return _decoded(payload, url=True) is not None
    return _json(payload) is not None and (found["alg"].lower() == "none" or bool(_decoded(signature, url=True)))


def _structure(body: bytes | None) -> str | None:
    return None if body is None else "der" if der_fits(body) else "wire" if wire_fits(body) else None


class _Run:
    """Base64 over several lines. Its bytes are decoded once for each of the four places a quad may begin at; a place of the text maps to a byte by its line."""

    def __init__(self, text: str, start: int, stop: int):
        self.start, self.stop = start, stop
        spans = [m.span() for m in _PIECE.finditer(text, start, stop)]
        self.begins = [a for a, _ in spans]
        self.offsets = [0, *accumulate(b - a for a, b in spans)]
        self.joined = "".join(text[a:b] for a, b in spans)
        self.length = len(self.joined.rstrip("="))
        self.decoded: dict[int, bytes] = {}
        self.known: dict[int, dict[int, int]] = {}

    def place(self, offset: int) -> int:
        """Where in the text a character of the run stands."""
        line = bisect_right(self.offsets, offset) - 1
        return self.begins[line] + offset - self.offsets[line]

    def structure(self, at: int) -> tuple[str, bytes, int] | None:
        """(kind, bytes, end) of what begins at a place of the text: a DER sequence as long as it says, anything else to the run's end."""
        line = bisect_right(self.begins, at) - 1
        offset = self.offsets[line] + at - self.begins[line]
        way = offset % 4
        if way not in self.decoded:
            whole = self.length - way
            self.decoded[way] = _decoded(self.joined[way : way + whole - (whole % 4 == 1)]) or b""
        raw, i = self.decoded[way], offset // 4 * 3
        if self.joined[offset] == "M":
            top = der_element(raw, i, len(raw))
            if top is None:
                return None
            n = top[2] - i
            chars = -(-4 * n // 3)
            # a quad that the sequence doesn't fill must be the last one
            if n % 3 and offset + chars != self.length or not der_fits(raw, i, top[2]):
                return None
            end = offset + chars if n % 3 == 0 else len(self.joined)
            return "der", raw[i : top[2]], self.place(end - 1) + 1
        if (self.length - offset) % 4 == 1 or not wire_fits(raw, i, self.known.setdefault(way, {})):
            return None
        return "wire", raw[i:], self.stop


def base_spans(text: str, raw: bytes) -> list[Span]:
    out: list[Span] = []
    low = raw.lower()
    if any(w in low for w in WORDS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if b"AKIA" in raw:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return out


def armoured(text: str) -> list[tuple[int, int]]:
    """Private keys between their first and last line: base64 over lines, whose ends may be written as escapes, and header lines (``Name: value``)."""
    begins, ends = list(BEGIN.finditer(text)), {}
    for m in END.finditer(text):
        ends.setdefault(m[1], []).append(m)
    out = []
    for m, after in zip_longest(begins, begins[1:]):
        of = ends.get(m[1], [])
        k = bisect_right(of, m.end() - 1, key=lambda e: e.start())
        if k == len(of) or after and of[k].start() > after.start():
            continue
        headers, body = [], []
        for line in _LINE_END.split(text[m.end() : of[k].start()]):
            (headers if _HEADER.fullmatch(line) else body).append(line)
        if not all(map(_BODY.fullmatch, body)):
            continue
        coded = _decoded("".join("".join(body).split()))
        # an encrypted body (its headers say so) can't be parsed, only decoded
        if coded and (_structure(coded) or any(h.startswith("DEK-Info:") for h in headers)):
            out.append((m.start(), of[k].end()))
    return out


def confirmed(text: str, raw: bytes) -> list[tuple[Span, bool]]:
    """Spans with what tells whether each is a public key."""
    out: list[tuple[Span, bool]] = []
    if b"eyJ" in raw:
        out += [(("token", *m.span()), False) for m in TOKEN.finditer(text) if _signed(*m.groups())]
    if b"-----BEGIN " in raw:
        out += [(("armour", a, b), False) for a, b in armoured(text)]
    end, run = 0, None
    for m in CODED.finditer(text):
        if m.start() < end:
            continue
        body, end = _decoded(m[0]), m.end()
        kind = _structure(body)
        if not kind and text[end : end + 2].lstrip("\r")[:1] == "\n":
            if run is None or not run.start <= m.start() < run.stop:
                lines = WRAPPED.match(text, m.start())
                run = _Run(text, *lines.span()) if lines else None
            if run and (more := run.structure(m.start())):
                kind, body, end = more
        if kind:
            out.append(((kind, m.start(), end), public(body)))
    for m in HEX_CODED.finditer(text):
        if len(m[0]) % 2 == 0 and (kind := _structure(body := bytes.fromhex(m[0]))):
            out.append(((kind, *m.span()), public(body)))
    return out


_PLACE = {k: i for i, k in enumerate(KINDS)}


def find_secrets(text: str | None) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), each sorted."""
    if not text:
        return [], []
    raw = text.encode()
    order = lambda s: (s[1], _PLACE[s[0]], s[2])
    base = sorted(base_spans(text, raw), key=order)
    more = [span for span, _ in confirmed(text, raw)]
    return base, sorted(base + more, key=order) if more else base


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str | None, mark: str = "[SECRET]") -> str | None:
    """The text with every span but those of public keys, overlapping ones as one, replaced by ``mark``."""
    spans = find_secrets(text)[1]
    open_to_all = {span for span, known in confirmed(text, text.encode()) if known} if any(s[0] in ("der", "wire") for s in spans) else set()
    spans = [s for s in spans if s not in open_to_all]
    if not spans:
        return text
    out, at = [], 0
    for _, a, b in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: counts of the base kinds, their digest, and all spans as text."""

    def kernel():
        empty = hashlib.sha256(b"").hexdigest()

        def step(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")}
            for t in column(batch, text_col):
                base, every = find_secrets(t)
                kinds = [s[0] for s in base]
                for k in BASE_KINDS:
                    out[f"n_{k}"].append(kinds.count(k))
                out["base_sha256"].append(hashlib.sha256(written(base).encode()).hexdigest() if base else empty)
                out["spans"].append(written(every))
            return {"doc_id": column(batch, id_col)} | out

        return step

    return map_texts(docs.select(id_col, text_col), kernel, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string", text_col)


def redacted(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with all its columns, secrets replaced by a mark; the length column, where there is one, follows the text."""
    schema = docs.schema

    def kernel():
        def step(batch: pa.RecordBatch) -> dict:
            cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            old = column(batch, text_col)
            new = [redact(t) for t in old]
            cols[text_col] = pa.array(new, batch.schema.field(text_col).type)
            if length_col in cols:
                kept = column(batch, length_col)
                cols[length_col] = pa.array([k if a == b else len(b) for k, a, b in zip(kept, old, new, strict=True)], batch.schema.field(length_col).type)
            return cols

        return step

    return map_texts(docs, kernel, schema, text_col)
