"""Secret scans with structural confirmation.

Base spans (``assign``, ``access``, ``hex``) come from their patterns alone. The method adds spans whose *structure* says that they are
keys: base64 or hex candidates are decoded, and key encodings (nested DER lengths, the length-prefixed OpenSSH layout) and
signed-token headers are parsed before anything is reported.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches, quote_columns

#: All kinds, in the order in which spans with one start are listed; the first three are the base.
KINDS = ("assign", "access", "hex", "pem_key", "der_key", "hex_key", "ssh_key", "signed_token")
BASE = KINDS[:3]

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,20}PRIVATE KEY)-----((?:(?!-----)[A-Za-z0-9+/=\s:,-])*+)-----END \1-----")
PEM_BYTES = re.compile(PEM.pattern.encode())
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}")
LONG_HEX = re.compile(r"[0-9A-Fa-f]{64,}")
#: Where a key may begin: 0x30 gives M; the other magic and an armoured key in base64 give more. In hex, 30 or the magic.
KEY_START = re.compile("M|b3BlbnNzaC1rZXktdjEA|LS0tLS1CRUdJTi")
HEX_START = re.compile("30|6f70656e7373682d6b65792d763100", re.I)
SIGNED = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{12,}+\.[A-Za-z0-9_-]{2,}\.[A-Za-z0-9_-]*")


#: No sequence of a key has more items, and no public key more fields, so that looking at a place takes a bounded number of steps.
MOST_ITEMS = 16


def der_items(data: bytes | memoryview) -> list[tuple[int, memoryview]] | None:
    """(tag, content) of the DER items that fill ``data`` exactly, or None if a length doesn't fit or they are more than a key has; nothing is copied."""
    data = memoryview(data)
    out, i, n = [], 0, len(data)
    while i < n:
        if i + 2 > n or len(out) == MOST_ITEMS:
            return None
        tag, size, i = data[i], data[i + 1], i + 2
        if size & 0x80:
            k = size & 0x7F
            if not 1 <= k <= 4 or i + k > n:
                return None
            size, i = int.from_bytes(data[i : i + k], "big"), i + k
            if size < 0x80:
                return None  # DER writes a short length in one byte
        if i + size > n:
            return None
        out.append((tag, data[i : i + size]))
        i += size
    return out


def is_rsa(items: list[tuple[int, memoryview]]) -> bool:
    """PKCS #1: version, modulus, exponents, primes."""
    return len(items) >= 9 and {t for t, _ in items[:9]} == {0x02} and items[0][1] in (b"\0", b"\1") and all(v for _, v in items[:9])


def is_ec(items: list[tuple[int, memoryview]]) -> bool:
    """SEC 1: version, number, parameters and public key."""
    return [t for t, _ in items[:2]] == [0x02, 0x04] and items[0][1] == b"\1" and len(items[1][1]) >= 16 and all(t in (0xA0, 0xA1) and der_items(v) for t, v in items[2:])


def is_der_key(data: bytes | memoryview) -> bool:
    """A private key in DER: PKCS #1, PKCS #8 (also encrypted) or SEC 1, with every nested length right, those of the key inside PKCS #8 as well."""
    if len(data) < 24 or data[0] != 0x30:
        return False
    top = der_items(data)
    if not top or len(top) != 1 or not (inner := der_items(top[0][1])):
        return False
    tags = [t for t, _ in inner]
    if tags[:3] == [0x02, 0x30, 0x04] and inner[0][1] in (b"\0", b"\1"):  # version, algorithm, key
        algorithm, key = der_items(inner[1][1]), der_items(inner[2][1])
        if not algorithm or algorithm[0][0] != 0x06 or not key or len(key) != 1 or not all(t in (0xA0, 0xA1, 0x81) for t in tags[3:]):
            return False
        if key[0][0] == 0x30:
            return bool(parts := der_items(key[0][1])) and (is_rsa(parts) or is_ec(parts))
        return key[0][0] == 0x02 and bool(key[0][1]) or key[0][0] == 0x04 and len(key[0][1]) >= 32  # a number alone, or the octets of a curve of fixed form
    if tags == [0x30, 0x04]:  # encrypted: algorithm, data
        algorithm = der_items(inner[0][1])
        return bool(algorithm) and algorithm[0][0] == 0x06 and len(algorithm) == 2 and der_items(algorithm[1][1]) is not None and len(inner[1][1]) >= 16 and len(inner[1][1]) % 8 == 0
    return is_rsa(inner) or is_ec(inner)


def fields(data: bytes | memoryview) -> list[memoryview] | None:
    """Length-prefixed fields that fill ``data``, or None, also if they are more than a public key has."""
    data = memoryview(data)
    out, i = [], 0
    while i < len(data):
        if len(out) == MOST_ITEMS:
            return None
        n = int.from_bytes(data[i : i + 4], "big")
        if i + 4 + n > len(data):
            return None
        out.append(data[i + 4 : i + 4 + n])
        i += 4 + n
    return out


SSH_MAGIC = b"openssh-key-v1\0"


def ssh_key_size(data: bytes, start: int = 0) -> int:
    """Bytes of the OpenSSH private key that begins at ``start``, or 0: its magic, cipher, derivation and options, public keys whose own fields fit, and the private part."""
    if not data.startswith(SSH_MAGIC, start):
        return 0
    at, data = start + len(SSH_MAGIC), memoryview(data)

    def field() -> memoryview:
        nonlocal at
        begin, at = at + 4, at + 4 + int.from_bytes(data[at : at + 4], "big")
        if at > len(data):
            raise ValueError("a field runs over the end")
        return data[begin:at]

    try:
        cipher, _, _ = field(), field(), field()
        count, at = int.from_bytes(data[at : at + 4], "big"), at + 4
        if not 1 <= count <= 64:
            return 0
        for _ in range(count):
            parts = fields(field())
            if not parts or len(parts) < 2 or not re.fullmatch(rb"[a-z0-9@.-]{4,64}", parts[0]):
                return 0
        private = field()
    except ValueError:
        return 0
    if len(private) < 8 or len(private) % 8 or cipher == b"none" and private[:4] != private[4:8]:
        return 0
    return at - start


def is_ssh_key(data: bytes) -> bool:
    return bool(data) and ssh_key_size(data) == len(data)


def is_sealed(headers: str, data: bytes) -> bool:
    """The body of a PEM key that is encrypted as a whole: its header names cipher and start value, and the body is whole blocks."""
    m = re.search(r"^DEK-Info: ?[A-Z0-9-]{4,20},([0-9A-Fa-f]{16}|[0-9A-Fa-f]{32})\s*$", headers, re.M)
    return bool(m) and "Proc-Type: 4,ENCRYPTED" in headers and len(data) >= 64 and len(data) % (len(m[1]) // 2) == 0


def decode64(text: str) -> bytes | None:
    body = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def is_signed_token(text: str) -> bool:
    """A header and a payload that decode to JSON objects, the header with an algorithm; a signature unless the algorithm is none."""
    parts = text.split(".")
    try:
        header, payload = (json.loads(decode64(p) or b"") for p in parts[:2])
    except (ValueError, RecursionError):
        return False
    if not isinstance(header, dict) or not isinstance(payload, dict) or not isinstance(header.get("alg"), str):
        return False
    return header["alg"].lower() == "none" or len(parts[2]) >= 16


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return out


def der_size(head: bytes) -> int:
    """Bytes of the DER sequence that begins with ``head`` (8 bytes at least), or 0 if none does that may be a key."""
    if head[0] != 0x30:
        return 0
    if head[1] < 0x80:
        size, at = head[1], 2
    elif 0x81 <= head[1] <= 0x83:
        at = 2 + (head[1] & 0x7F)
        size = int.from_bytes(head[2:at], "big")
    else:
        return 0
    return at + size if head[at] in (0x02, 0x30) else 0


def keys_in_base64(run: str) -> Iterator[tuple[int, int, str]]:
    """Keys in a run of base64 characters: they may be glued to what stands before and after. Each place costs a few characters unless a header is right there."""
    at, decoded = 0, {}

    def bytes_at(i: int) -> tuple[bytes, int]:
        """The run as bytes and where they begin at ``i``; it is decoded once for each of the four alignments."""
        if (a := i % 4) not in decoded:
            decoded[a] = decode64(run[a : len(run) - ((len(run) - a) % 4 == 1)]) or b""
        return decoded[a], (i - a) // 4 * 3

    for m in KEY_START.finditer(run):
        i = m.start()
        if i < at:
            continue
        if m[0] == "M":
            head = decode64(run[i : i + 12])
            size = der_size(head) if head and len(head) >= 8 else 0
            if size < 24:
                continue
            data, start = bytes_at(i)
            if start + size > len(data) or not is_der_key(memoryview(data)[start : start + size]):
                continue
            chars, kind = -(-size * 4 // 3), "der_key"
        elif m[0].startswith("b3"):
            size = ssh_key_size(*bytes_at(i))
            if not size:
                continue
            chars, kind = -(-size * 4 // 3), "ssh_key"
        else:
            data, start = bytes_at(i)
            inner = PEM_BYTES.match(data, start)
            if not inner or not pem_proved(PEM.match(inner[0].decode("ascii"))):
                continue
            chars, kind = -(-len(inner[0]) * 4 // 3), "pem_key"
        at = i + chars
        yield i, at, kind


def pem_proved(m: re.Match) -> bool:
    """Whether the body of a PEM block has the structure of a key."""
    headers, body = [x for x in m[2].split("\n") if ":" in x], "".join(x for x in m[2].split("\n") if ":" not in x)
    data = decode64("".join(body.split()))
    return bool(data) and (is_der_key(data) or is_ssh_key(data) or is_sealed("\n".join(headers), data))


def structural_spans(text: str) -> list[tuple[int, int, str]]:
    out, armoured = [], []
    if "-----BEGIN " in text:
        for m in PEM.finditer(text):
            if pem_proved(m):
                out.append((m.start(), m.end(), "pem_key"))
                armoured.append((m.start(), m.end()))
    for m in BASE64.finditer(text):
        k = bisect.bisect_right(armoured, (m.start(), len(text))) - 1
        if k >= 0 and m.start() < armoured[k][1]:
            continue
        for s, e, kind in keys_in_base64(m[0].rstrip("=")):
            e += m.start()
            pad = len(m[0]) - len(m[0].rstrip("="))
            out.append((m.start() + s, e + (pad if e + pad == m.end() else 0), kind))
    for m in LONG_HEX.finditer(text):
        at, run = 0, m[0]
        halves = [bytes.fromhex(run[a : len(run) - (len(run) - a) % 2]) for a in (0, 1)]  # decoded once for each alignment
        for k in HEX_START.finditer(run):
            i = k.start()
            if i < at:
                continue
            data, start = halves[i % 2], i // 2
            if k[0] == "30":
                size = der_size(data[start : start + 8]) if i + 16 <= len(run) else 0
                if size < 24 or start + size > len(data) or not is_der_key(memoryview(data)[start : start + size]):
                    continue
            elif not (size := ssh_key_size(data, start)):
                continue
            at = i + 2 * size
            out.append((m.start() + i, m.start() + at, "hex_key"))
    out += [(m.start(), m.end(), "signed_token") for m in SIGNED.finditer(text) if is_signed_token(m[0])] if "." in text else []
    return out


def find_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by start and then kind as listed. Spans of different kinds may overlap."""
    return sorted(base_spans(text) + structural_spans(text), key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def span_text(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def redact(text: str | None, spans: list[tuple[int, int, str]], mark: str = "[{}]") -> str | None:
    """``text`` with each run of overlapping spans replaced by the kind of its first span; null stays null."""
    if not text or not spans:
        return text
    out, at, i = [], 0, 0
    spans = sorted(spans)
    while i < len(spans):
        s, e, kind = spans[i]
        i += 1
        while i < len(spans) and spans[i][0] < e:
            e, i = max(e, spans[i][1]), i + 1
        out += [text[at:s], mark.format(kind)]
        at = e
    return "".join([*out, text[at:]])


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, counts of the base kinds, ``base_sha256``, ``spans`` (all, as kind:start:end) and ``redacted``; and the columns named in ``keep``.

    One pass without shuffle, in Arrow batches of bounded bytes. Scanning is linear in the text: candidates are maximal runs, each
    decoded once for each alignment, and a place in a run that looks like a header costs a bounded number of steps. Null and empty texts have no spans (redacted stays null or empty); repeated rows each get a row; further
    columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                spans = find_spans(text or "")
                base = [s for s in spans if s[2] in BASE]
                kinds = [s[2] for s in base]
                rows.append((*map(kinds.count, BASE), hashlib.sha256(span_text(base).encode()).hexdigest(), span_text(spans), redact(text, spans)))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], *[pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 3 + [pa.string()] * 3, strict=True)]], [id_col, *keep, "n_assign", "n_access", "n_hex", "base_sha256", "spans", "redacted"])

    kept = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in (id_col, *keep))
    return map_batches(docs.select(*quote_columns(docs, id_col, text_col, *keep)), run, kept + "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, redacted string")
