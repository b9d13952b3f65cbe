"""Secret scan with structural confirmation.

Plain patterns find assignments, access keys and long hex runs.  Longer candidates in
base64 or hex are decoded, and reported only if what they hold proves them:

    pem      a private-key block whose body decodes to a key encoding (DER, nested
             lengths all exact) or to the framed strings of an OpenSSH key, or is said
             to be encrypted by its headers; line ends may be escaped, as in JSON
    jwt      three base64url parts, the first of which is a JSON header that names an
             algorithm, the second JSON too
    der      a bare base64 or hex run that begins, at a border in it, with one
             private-key encoding
    openssh  a bare base64 or hex run that holds an OpenSSH private key
    wrapped  a bare base64 or hex run whose text holds an access key, an assignment of
             a key or the first line of a private-key block

A bare run may go on over line ends and may have other letters glued to it: it is
decoded from each of its first four letters (two in hex), so what it holds is found
wherever it begins, and the span is that of the letters which hold it.

Cases: null and empty texts have no spans.  Spans are in code points, end exclusive.
Each row is scanned whole and by itself.  A candidate is decoded four times and twice,
so work grows with the length of the text.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quayline.llm.tables import map_batches, read_table

# The plain patterns and the least lengths of what they report.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_VALUE = 6
LEAST_ACCESS = 20
#: Without one of these, in any case, a text has no assignment.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
HELD_WORDS = tuple(w.encode() for w in (*ASSIGN_WORDS, "akia", "private key-----"))

PEM_MARK = re.compile(r"-----(?:(BEGIN) ([A-Z0-9]+ )*|END [A-Z0-9 ]*)PRIVATE KEY-----")
JWT = re.compile(r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+")
#: Letters that hold the shortest text to be reported, "token=" and LEAST_VALUE letters.
LEAST_BLOB = 16
BREAK = re.compile(r"[ \t]*(?:\r?\n|\r|\\+r\\+n|\\+n)[ \t]*")
#: A run of that length, or one that goes on after a line end.
BLOB = re.compile(
    r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{16,}+|[A-Za-z0-9+/_-]++(?=BREAK[A-Za-z0-9+/_-]))(?:BREAK[A-Za-z0-9+/_-]++)*+={0,2}".replace(
        "BREAK", BREAK.pattern
    )
)
HEX_RUN = re.compile(r"[0-9A-Fa-f]{24,}")
#: The first letters of a key in DER, at the beginning of a run or after a border in it.
KEY_START = re.compile(r"(?<![A-Za-z0-9])M[A-P]")
STANDARD = str.maketrans("-_", "+/")
PRINTABLE = re.compile(rb"[\t\n\r\x20-\x7e]{12,}")
#: Line ends, blanks and slashes as JSON and source code write them, however often escaped.
ESCAPED_BREAK = re.compile(r"\\+[rnt]")
ESCAPE = re.compile(r"\\+")
ENCRYPTED = re.compile(r"Proc-Type:[ \t]*4,[ \t]*ENCRYPTED")
#: Headers of a block: first the two of encrypted keys, which may stand in one line with
#: all the rest, then lines of others.
KEY_HEADERS = re.compile(ENCRYPTED.pattern + r"|DEK-Info:[ \t]*[A-Za-z0-9-]+(?:,[0-9A-Fa-f]+)?")
PEM_HEADERS = re.compile(r"^[ \t]*[A-Za-z][A-Za-z0-9-]*:.*$", re.M)
#: The least bytes of an encrypted body: a block of the cipher.
LEAST_CIPHER = 16

KINDS = ("assign", "access", "hex", "pem", "jwt", "der", "openssh", "wrapped")
BASE = KINDS[:3]
OPENSSH = b"openssh-key-v1\0"

# DER tags.
INTEGER, BIT_STRING, OCTET_STRING, OBJECT_ID, SEQUENCE = 0x02, 0x03, 0x04, 0x06, 0x30
NESTED = 0x20


def der_parts(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the values that fill data[start:end] exactly, else None."""
    out = []
    while start < end:
        if end - start < 2:
            return None
        tag, size, at = data[start], data[start + 1], start + 2
        if size & 0x80:
            more = size & 0x7F
            if not 1 <= more <= 4 or at + more > end:
                return None
            size, at = int.from_bytes(data[at : at + more], "big"), at + more
        if at + size > end:
            return None
        out.append((tag, at, at + size))
        start = at + size
    return out


def well_nested(data: bytes, parts: list[tuple[int, int, int]], depth: int = 0) -> bool:
    """Every constructed value is filled exactly by its parts."""
    if depth > 12:
        return False
    for tag, start, end in parts:
        if tag & NESTED:
            inner = der_parts(data, start, end)
            if inner is None or not well_nested(data, inner, depth + 1):
                return False
    return True


def is_key_der(data: bytes) -> bool:
    """One private-key encoding: a list of numbers (RSA, DSA), a version, algorithm and
    key (PKCS 8, plain or encrypted), or a version and key bytes (elliptic curves)."""
    outer = der_parts(data, 0, len(data))
    if outer is None or len(outer) != 1 or outer[0][0] != SEQUENCE:
        return False
    parts = der_parts(data, *outer[0][1:])
    if not parts or not well_nested(data, parts):
        return False
    tags = [p[0] for p in parts]
    small = tags[0] == INTEGER and parts[0][2] - parts[0][1] == 1

    def algorithm(k: int) -> bool:
        inner = der_parts(data, *parts[k][1:]) if k < len(parts) and tags[k] == SEQUENCE else None
        return bool(inner) and inner[0][0] == OBJECT_ID

    if small and len(parts) >= 6 and set(tags) == {INTEGER}:
        return True
    if small and tags[1:3] == [SEQUENCE, OCTET_STRING] and algorithm(1):
        return True
    if small and tags[1:2] == [OCTET_STRING] and parts[1][2] - parts[1][1] >= 16 and all(t & 0xE0 == 0xA0 for t in tags[2:]):
        return True
    return tags == [SEQUENCE, OCTET_STRING] and algorithm(0)


def key_der_end(data: bytes, start: int) -> int | None:
    """Where the private-key encoding ends that begins at ``start``, if one does."""
    if start + 2 > len(data) or data[start] != SEQUENCE:
        return None
    more = data[start + 1] & 0x7F if data[start + 1] & 0x80 else 0
    if more > 4:
        return None
    size = int.from_bytes(data[start + 2 : start + 2 + more], "big") if more else data[start + 1]
    end = start + 2 + more + size
    return end if end <= len(data) and is_key_der(data[start:end]) else None


def openssh_end(data: bytes, start: int) -> int | None:
    """Where an OpenSSH key ends that begins at ``start``: the magic, then strings framed
    by their lengths: cipher, kdf, its options, the number of keys, public and private
    parts."""
    if not data.startswith(OPENSSH, start):
        return None
    at = start + len(OPENSSH)
    for k in range(6):
        if at + 4 > len(data):
            return None
        size = int.from_bytes(data[at : at + 4], "big")
        at += 4
        if k == 3:
            if size < 1:
                return None
            continue
        at += size
    return at if at <= len(data) else None


def is_openssh(data: bytes) -> bool:
    """An OpenSSH key and nothing after it."""
    return openssh_end(data, 0) == len(data)


def from_base64(text: str) -> bytes | None:
    body = text.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def from_hex(text: str) -> bytes | None:
    try:
        return bytes.fromhex(text)
    except ValueError:
        return None


def is_json_object(data: bytes | None) -> dict | None:
    try:
        value = json.loads(data.decode("utf-8")) if data else None
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def is_jwt(token: str) -> bool:
    header, payload, _ = token.split(".")
    head = is_json_object(from_base64(header))
    return head is not None and isinstance(head.get("alg"), str) and is_json_object(from_base64(payload)) is not None


def is_wrapped(text: str) -> bool:
    """Whether a text holds a secret itself."""
    return "PRIVATE KEY-----" in text or any(kind in ("assign", "access") for kind, _, _ in base_spans(text))


def held(data: bytes, key_starts: list[int]) -> list[tuple[str, int, int]]:
    """What decoded bytes hold: keys in OpenSSH frames, keys in DER that begin at one of
    ``key_starts``, and stretches of text that hold a secret."""
    out = []
    at = data.find(OPENSSH)
    while at >= 0:
        end = openssh_end(data, at)
        if end:
            out.append(("openssh", at, end))
        at = data.find(OPENSSH, end or at + 1)
    for start in key_starts:
        end = key_der_end(data, start)
        if end:
            out.append(("der", start, end))
    lower = data.lower()
    if any(word in lower for word in HELD_WORDS):
        out += [("wrapped", *m.span()) for m in PRINTABLE.finditer(data) if is_wrapped(m[0].decode("ascii"))]
    return out


def blob_spans(run: str) -> list[tuple[str, int, int]]:
    """Spans of the proved secrets in a run of base64 or hex, which may have line ends."""
    # The run's letters alone, and where each of its lines is among them and in the run.
    places, lines, at = [], [], 0
    for m in [*BREAK.finditer(run), None]:
        end = m.start() if m else len(run.rstrip("="))
        places.append((sum(map(len, lines[-1:])) + (places[-1][0] if places else 0), at))
        lines.append(run[at:end])
        at = m.end() if m else end
    letters = "".join(lines)
    if len(letters) < LEAST_BLOB:
        return []
    firsts = [p[0] for p in places]

    def place(k: int) -> int:
        first, at = places[bisect_right(firsts, k) - 1]
        return at + k - first

    def span(kind: str, start: int, end: int) -> tuple[str, int, int]:
        return kind, place(start), len(run) if end >= len(letters) else place(end - 1) + 1

    out = []
    for m in HEX_RUN.finditer(letters):
        # A key begins with the run's first digit, or that of a line.
        borders = [m.start(), *firsts[bisect_right(firsts, m.start()) : bisect_left(firsts, m.end())]]
        for first in (m.start(), m.start() + 1):
            data = bytes.fromhex(letters[first : m.end() - (m.end() - first) % 2])
            starts = [(b - first) // 2 for b in borders if b >= first and (b - first) % 2 == 0]
            out += [span(kind, first + 2 * a, first + 2 * b) for kind, a, b in held(data, starts)]
    starts = {m.start() for m in KEY_START.finditer(letters)}
    starts.update(k for k in firsts if letters.startswith("M", k))
    body = letters.translate(STANDARD)
    for first in range(4):
        size = len(body) - first
        size -= size % 4 == 1
        data = binascii.a2b_base64(body[first : first + size] + "=" * (-size % 4))
        at = sorted((k - first) // 4 * 3 for k in starts if k >= first and (k - first) % 4 == 0)
        out += [span(kind, first + a * 4 // 3, first + -(-b * 4 // 3)) for kind, a, b in held(data, at)]
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    lower = text.lower()
    if any(w in lower for w in ASSIGN_WORDS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return out


def pem_blocks(text: str) -> list[tuple[int, int, int, int]]:
    """Start of a block, start and end of its body, end of the block.  An END line
    belongs to the last BEGIN line before it; each line is looked at once."""
    out, opened = [], None
    for m in PEM_MARK.finditer(text):
        if m[1]:
            opened = m
        elif opened:
            out.append((opened.start(), opened.end(), m.start(), m.end()))
            opened = None
    return out


def is_pem_key(block: str) -> bool:
    """Whether the body of a block, headers and escapes aside, is a private key; of an
    encrypted one only the header and that it decodes can be known."""
    lines = ESCAPE.sub("", ESCAPED_BREAK.sub("\n", block)).replace("\r", "\n")
    body = "".join(PEM_HEADERS.sub("", KEY_HEADERS.sub("", lines)).split())
    data = from_base64(body) if body else None
    if not data:
        return False
    return is_openssh(data) or is_key_der(data) or (len(data) >= LEAST_CIPHER and bool(ENCRYPTED.search(lines)))


def confirmed_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans beyond the plain patterns, each proved by its structure."""
    out = []
    if "PRIVATE KEY-----" in text:
        out += [("pem", a, d) for a, b, c, d in pem_blocks(text) if is_pem_key(text[b:c])]
    if "eyJ" in text:
        out += [("jwt", *m.span()) for m in JWT.finditer(text) if is_jwt(m[0])]
    for m in BLOB.finditer(text):
        for kind, start, end in blob_spans(m[0]):
            start, end = m.start() + start, m.start() + end
            if not any(a <= start and end <= b for _, a, b in out):
                out.append((kind, start, end))
    return out


def in_order(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def scan(text: str | None) -> list[tuple[str, int, int]]:
    """All spans of a text by start, then kind."""
    return in_order(base_spans(text) + confirmed_spans(text)) if text else []


def redacted(text: str | None, spans: list[tuple[str, int, int]], mark: str) -> str | None:
    """The text with every span, overlapping ones as one, replaced by a mark."""
    if not spans:
        return text
    out, at = [], 0
    for _, start, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the id column and ``spans``: kind, start and end of each secret."""

    def make():
        def one(batch: pa.RecordBatch) -> dict:
            found = [[{"kind": k, "start": a, "end": b} for k, a, b in scan(t)] for t in batch.column(1).to_pylist()]
            return {id_col: batch.column(0), "spans": found}

        return one

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs, [id_col, text_col], f"`{id_col}` {kind}, spans array<struct<kind: string, start: int, end: int>>", make)


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[secret]", length_col: str | None = None) -> DataFrame:
    """All rows and columns, with secrets in the text replaced by ``mark``; a column of
    text lengths follows if it is named."""
    fields = docs.schema

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            old = batch.column(at).to_pylist()
            new = [redacted(t, scan(t), mark) for t in old]
            columns = list(batch.columns)
            columns[at] = pa.array(new, batch.schema.field(at).type)
            if length_col:
                k = batch.schema.get_field_index(length_col)
                was = columns[k].to_pylist()
                columns[k] = pa.array(
                    [n if a == b else len(b) for a, b, n in zip(old, new, was, strict=True)], batch.schema.field(k).type
                )
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, fields)


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make():
        def one(batch: pa.RecordBatch) -> dict:
            found = [scan(t) for t in batch.column(1).to_pylist()]
            counts = {f"n_{kind}": [sum(s[0] == kind for s in spans) for spans in found] for kind in BASE}
            digests = [hashlib.sha256(joined([s for s in spans if s[0] in BASE]).encode()).hexdigest() for spans in found]
            return {"doc_id": batch.column(0), **counts, "base_sha256": digests, "spans": [joined(s) for s in found]}

        return one

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return map_batches(read_table(spark, sf_dir, "documents"), ["doc_id", "text"], schema, make)
