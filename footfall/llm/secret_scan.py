"""Secret scans: plain patterns, and structural confirmation of encoded keys and signed tokens.

A base64 or hex candidate is only reported if what it decodes to has the structure of a key or a signed token: nested
DER lengths that fit exactly, an OpenSSH private key container, or a token header in JSON that names an algorithm.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches


def _either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


#: Kinds in the order that breaks ties between spans with the same start; the first three are the contract's.
KINDS = ("assign", "access", "hex", "pem", "der", "ssh", "jwt")
KEYWORDS = "|".join(map(_either, ("password", "passwd", "secret", "token"))) + f"|{_either('api')}_?{_either('key')}"
ASSIGN = re.compile(rf"""({KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
# a maximal run shorter than the least length holds no longer match, so the length can stand in the pattern
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
JWT = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]*)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")
#: An armoured key; its lines may be ended by an escaped \n, as in JSON, and headers may say how it is encrypted.
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----((?:(?!-----)(?:[A-Za-z0-9+/=:,.\s-]|\\[nrt]))*+)-----END \1-----")
PEM_HEADERS = re.compile(r"Proc-Type: 4,ENCRYPTED\s+DEK-Info: [A-Z0-9-]+,[0-9A-Fa-f]+\s")
ESCAPED = re.compile(r"\\[nrt]|\s")
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}={0,2}")
#: What follows a line of base64 when it goes on in the next.
NEXT_LINE = re.compile(r"(?:\r?\n|(?:\\r)?\\n)[ \t]*([A-Za-z0-9+/]+={0,2})")
HEX_ANY = re.compile(r"(?<![0-9A-Za-z])(?:[0-9a-f]{64,}|[0-9A-F]{64,})(?![0-9A-Za-z])")
#: How the base64 of an OpenSSH container begins.
SSH_MAGIC = "b3BlbnNzaC1rZXktdjE"
#: Object identifiers of password-based encryption (PKCS#5 and PKCS#12), as encoded.
PBE = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))


def decode_base64(text: str) -> bytes | None:
    """Bytes of standard or url-safe base64 with or without padding, else None."""
    text = text.translate({ord("-"): "+", ord("_"): "/"}).rstrip("=")
    if len(text) % 4 == 1:
        return None
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _der(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, start, end) of the value of one DER element inside [at, end), else None."""
    if at + 2 > end:
        return None
    tag, length, at = data[at], data[at + 1], at + 2
    if length & 0x80:
        n = length & 0x7F
        if not 1 <= n <= 4 or at + n > end:
            return None
        length, at = int.from_bytes(data[at : at + n], "big"), at + n
        if length < 0x80:
            return None
    return (tag, at, at + length) if at + length <= end else None


def _der_parts(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """The elements that fill [at, end) exactly, else None."""
    parts = []
    while at < end:
        part = _der(data, at, end)
        if not part:
            return None
        parts.append(part)
        at = part[2]
    return parts


def der_key(data: bytes) -> bool:
    """A DER private key: an outer sequence over all bytes and elements that fill it exactly. After a small version number
    PKCS#1 has eight integers, PKCS#8 an algorithm with an object identifier and an octet string, SEC 1 an octet
    string; an encrypted PKCS#8 has no version, but an algorithm of password-based encryption and an octet string."""
    outer = _der(data, 0, len(data))
    if not outer or outer[0] != 0x30 or outer[2] != len(data):
        return False
    parts = _der_parts(data, outer[1], outer[2])
    if not parts or len(parts) < 2:
        return False

    def algorithm(part: tuple[int, int, int]) -> bytes:
        oid = _der(data, part[1], part[2]) if part[0] == 0x30 else None
        return data[oid[1] : oid[2]] if oid and oid[0] == 0x06 else b""

    tags = [p[0] for p in parts]
    if tags == [0x30, 0x04]:
        return algorithm(parts[0]).startswith(PBE) and parts[1][2] - parts[1][1] >= 16
    if tags[0] != 0x02 or parts[0][2] - parts[0][1] != 1 or data[parts[0][1]] > 2:
        return False
    if len(parts) >= 9 and all(t == 0x02 for t in tags[:9]):
        return True
    if len(parts) >= 3 and tags[1] == 0x30 and tags[2] == 0x04:
        return bool(algorithm(parts[1]))
    return tags[1] == 0x04 and parts[1][2] - parts[1][1] >= 20


def ssh_key(data: bytes) -> bool:
    """An OpenSSH private key container: its magic, then cipher, kdf and options as length-prefixed strings that fit."""
    magic, at = b"openssh-key-v1\0", 15
    if not data.startswith(magic):
        return False
    for _ in range(3):
        if at + 4 > len(data):
            return False
        at += 4 + int.from_bytes(data[at : at + 4], "big")
    return at + 4 <= len(data) and 1 <= int.from_bytes(data[at : at + 4], "big") <= 16


def ssh_size(data: bytes) -> int:
    """Bytes of the OpenSSH container that data starts with, by the lengths of its public keys and its private part; all
    of data where these do not fit."""
    at, fields = 15, 3
    for _ in range(fields):
        at += 4 + int.from_bytes(data[at : at + 4], "big")
    keys, at = int.from_bytes(data[at : at + 4], "big"), at + 4
    for _ in range(keys + 1):
        if at + 4 > len(data):
            return len(data)
        at += 4 + int.from_bytes(data[at : at + 4], "big")
    return min(at, len(data))


def signed_token(header: str, payload: str) -> bool:
    """A header that decodes to a JSON object naming `alg`, and a payload that decodes to a JSON object or is opaque
    base64 (encrypted) with `enc` named."""
    try:
        head = json.loads(decode_base64(header) or b"")
        if not isinstance(head, dict) or not isinstance(head.get("alg"), str):
            return False
        return "enc" in head or isinstance(json.loads(decode_base64(payload) or b""), dict)
    except (ValueError, RecursionError):
        return False


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text)]
    return out + [("hex", *m.span()) for m in HEX.finditer(text)]


def _stated(head: bytes) -> int:
    """Bytes of the DER element that begins with head, by its own header."""
    n = head[1] & 0x7F if head[1] & 0x80 else 0
    return 2 + n + (int.from_bytes(head[2 : 2 + n], "big") if n else head[1])


def _wrapped(text: str, first: re.Match) -> tuple[str, int, int] | None:
    """A key whose base64 begins with the candidate and goes on in the lines below it. How much of them belongs to it
    follows from the length that a DER key states, and no more is read; an OpenSSH container ends with its lines, or where
    another begins."""
    ssh = first[0].startswith(SSH_MAGIC)
    head = decode_base64(first[0][:16]) or b""
    if not ssh and (head[:1] != b"\x30" or len(head) < 7):
        return None
    size = 0 if ssh else _stated(head)
    wanted = -(-size // 3) * 4 - (-size % 3)  # characters without padding
    if not ssh and wanted > len(text) - first.start():
        return None
    pieces, at, held = [(first.start(), first[0])], first.end(), len(first[0])
    while (ssh or held < wanted) and (following := NEXT_LINE.match(text, at)):
        if ssh and following[1].startswith(SSH_MAGIC):
            break
        pieces.append((following.start(1), following[1]))
        at, held = following.end(), held + len(following[1])
        if following[1].endswith("="):
            break
    if len(pieces) == 1:
        return None
    joined = "".join(p for _, p in pieces).rstrip("=")
    if not ssh:
        joined = joined[:wanted]
    whole = decode_base64(joined[: len(joined) - (len(joined) % 4 == 1)]) or b""
    if ssh:
        if not ssh_key(whole):
            return None
        size = ssh_size(whole)
        wanted = -(-size // 3) * 4 - (-size % 3)
    elif not der_key(whole[:size]):
        return None
    for start, piece in pieces:
        if wanted <= len(piece):
            padding = piece[wanted:]
            return "ssh" if ssh else "der", first.start(), start + wanted + len(padding) - len(padding.lstrip("="))
        wanted -= len(piece)
    return None


class _Covered:
    """Spans that are taken, asked in ascending order of their starts."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.spans, self.at, self.end = sorted(spans), 0, -1

    def add(self, end: int) -> None:
        self.end = max(self.end, end)

    def holds(self, start: int, end: int) -> bool:
        while self.at < len(self.spans) and self.spans[self.at][0] <= start:
            self.add(self.spans[self.at][1])
            self.at += 1
        return end <= self.end


def confirmed_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans whose decoded structure is that of a key or token."""
    out = []
    if "eyJ" in text:
        out += [("jwt", *m.span()) for m in JWT.finditer(text) if signed_token(m[1], m[2])]
    if "-----BEGIN " in text:
        for m in PEM.finditer(text):
            headers = PEM_HEADERS.search(m[2].replace("\\n", "\n"))
            body = decode_base64(ESCAPED.sub("", PEM_HEADERS.sub("", m[2].replace("\\n", "\n"))))
            # under a legacy header the body is whole blocks of a cipher
            if body and (len(body) >= 64 and len(body) % 8 == 0 if headers else der_key(body) or ssh_key(body)):
                out.append(("pem", *m.span()))
    for pattern, decode in ((BASE64, decode_base64), (HEX_ANY, bytes.fromhex)):
        taken = _Covered([(s, e) for _, s, e in out])
        for m in pattern.finditer(text):
            found = m[0]
            # a DER sequence starts with 0x30, the ssh container with its magic
            if found[:1] not in ("M", "b", "3", "6") or pattern is HEX_ANY and len(found) % 2 or taken.holds(*m.span()):
                continue
            longer = _wrapped(text, m) if pattern is BASE64 and text[m.end() : m.end() + 1] in ("\n", "\r", "\\") else None
            if longer:
                out.append(longer)
                taken.add(longer[2])
            elif (data := decode(found)) and der_key(data):
                out.append(("der", *m.span()))
            elif data and ssh_key(data):
                out.append(("ssh", *m.span()))
    return out


def in_order(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in in_order(spans))


def redacted(text: str, spans: list[tuple[str, int, int]], mark: str = "[SECRET]") -> str:
    """The text with each run of overlapping spans replaced by one mark."""
    out, at = [], 0
    for _, start, end in in_order(spans):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Null text counts as empty (no spans; the digest of the empty string). Spans are code points, end exclusive; equal
    texts and repeated rows give equal results; other columns are dropped. No shuffle: every row is scanned where it is
    read, whole.
    """

    names = ["n_assign", "n_access", "n_hex", "base_sha256", "spans"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # doc_id stays an Arrow column: as a number of pandas, one null would round the others
            rows = []
            for text in batch.column("text").to_pylist():
                text = text or ""
                base = base_spans(text)
                kinds = [k for k, _, _ in base]
                digest = hashlib.sha256(joined(base).encode()).hexdigest()
                rows.append((kinds.count("assign"), kinds.count("access"), kinds.count("hex"), digest, joined(base + confirmed_spans(text))))
            columns = zip(*rows) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, columns, [*[pa.int64()] * 3, *[pa.string()] * 2])], ["doc_id", *names])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame) -> DataFrame:
    """docs with each secret in text replaced by a mark and n_chars, if there, counted anew; rows and columns stay.

    Texts without secrets, nulls included, are unchanged.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # the other columns stay as they are
            at = batch.schema.get_field_index("text")
            before = batch.column(at).to_pylist()
            after = [redacted(t, s) if t and (s := base_spans(t) + confirmed_spans(t)) else t for t in before]
            batch = batch.set_column(at, batch.schema.field(at), pa.array(after, batch.schema.field(at).type))
            count = batch.schema.get_field_index("n_chars")
            if count >= 0 and any(old is not new for old, new in zip(before, after)):
                sizes = [n if old is new else len(new) for n, old, new in zip(batch.column(count).to_pylist(), before, after)]
                batch = batch.set_column(count, batch.schema.field(count), pa.array(sizes, batch.schema.field(count).type))
            yield batch

    small_batches(docs.sparkSession)
    return docs.mapInArrow(work, docs.schema)
