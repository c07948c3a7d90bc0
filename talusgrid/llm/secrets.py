"""Secret scanning with structural confirmation.

Plain patterns give the base spans. Candidates in base64 or hexadecimal are decoded and must
parse before they are reported as well: DER key encodings with nested lengths that add up,
OpenSSH key blobs with length-prefixed fields, PEM blocks around either, and signed tokens
whose header is a JSON object naming an algorithm.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from talusgrid.llm import runtime as R

#: The base patterns, and the kinds of spans in their order.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "pem", "der", "ssh", "jwt")
WORDS = ("passw", "secret", "token", "api")
JWT = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{2,}\.[A-Za-z0-9_-]*")
#: Where keys in base64 may start: 0x30 and a length, or the length of a short field, or the name of OpenSSH's private keys.
DER = re.compile(r"M[A-I](?<![A-Za-z0-9+/_-]..)(?=[A-Za-z0-9+/\r\n]{61})")
SSH = re.compile(r"(?:AAAA(?<![A-Za-z0-9+/_-].{4})|b3BlbnNzaC1rZXkt(?<![A-Za-z0-9+/_-].{16}))(?=[A-Za-z0-9+/\r\n]{32})")
RUN = re.compile(r"[A-Za-z0-9+/\r\n]+")
LETTER = re.compile(r"[A-Za-z0-9+/]")
PADDING = re.compile(r"[\r\n]*={1,2}")
HEX_DER = re.compile(r"(?<![0-9A-Fa-f])30[0-9A-Fa-f]{62,}(?![0-9A-Fa-f])")
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{1,40})-----((?:\s*[A-Za-z0-9-]+: [^\n]*\n)*)([A-Za-z0-9+/=\s]+)-----END \1-----")
#: Headers of an encrypted key, and how many bytes its blocks have.
ENCRYPTED = re.compile(r"Proc-Type: 4,ENCRYPTED\s+DEK-Info: [A-Z0-9-]+,(?:[0-9A-Fa-f]{2}){8,16}\s")
_BLOCK = 8
ALGORITHM = re.compile(rb"(ssh|ecdsa|sk-)[a-z0-9@.-]+")

_MIN = {"assign": 12, "access": 18, "hex": 16}
#: Letters of a DER key that other letters may follow.
_LEAST = 62
#: Fields of a public key by its algorithm, and bytes that follow a private key's last field by its cipher.
_FIELDS = {b"ssh-rsa": 3, b"ssh-dss": 5, b"ssh-ed25519": 2, b"ssh-ed448": 2, b"ecdsa-sha2-nistp256": 3, b"ecdsa-sha2-nistp384": 3, b"ecdsa-sha2-nistp521": 3, b"sk-ssh-ed25519@openssh.com": 3, b"sk-ecdsa-sha2-nistp256@openssh.com": 4}
_TAGS = {b"aes128-gcm@openssh.com": 16, b"aes256-gcm@openssh.com": 16, b"chacha20-poly1305@openssh.com": 16}
_CONTAINERS = (0x30, 0x31, 0xA0, 0xA1, 0xA3)


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the base patterns: leftmost, not overlapping within a kind."""
    out = []
    low = text.lower() if "=" in text or ":" in text else ""
    if any(w in low for w in WORDS):
        out += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= _MIN["assign"]]
    if "AKIA" in text:
        out += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= _MIN["access"]]
    out += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return out


def _tlv(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, and where the content of the DER element at ``at`` starts and ends; None if it doesn't fit."""
    if at + 2 > end:
        return None
    tag, size, at = data[at], data[at + 1], at + 2
    if size >= 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or at + n > end:
            return None
        size, at = int.from_bytes(data[at : at + n], "big"), at + n
    return (tag, at, at + size) if at + size <= end else None


def der_elements(data: bytes, at: int = 0, end: int | None = None) -> list[int] | None:
    """Tags of a DER encoding (data[at:end]) in order, nested ones included; None unless all lengths add up."""
    tags: list[int] = []
    todo = [(at, len(data) if end is None else end)]
    while todo:
        at, end = todo.pop()
        while at < end:
            if (e := _tlv(data, at, end)) is None:
                return None
            tag, start, at = e
            tags.append(tag)
            if tag in _CONTAINERS:
                todo.append((start, at))
    return tags


def der_key_end(data: bytes, at: int = 0) -> int | None:
    """Where the key or certificate at ``at`` ends: one sequence that holds integers, bit or octet strings; None if there is none."""
    if at >= len(data) or data[at] != 0x30 or (whole := _tlv(data, at, len(data))) is None or whole[2] - at < 16:
        return None
    tags = der_elements(data, at=at, end=whole[2])
    ok = tags is not None and len(tags) >= 3 and bool({0x02, 0x03, 0x04} & set(tags[1:])) and (tags.count(0x02) >= 2 or 0x06 in tags or 0x04 in tags)
    return whole[2] if ok else None


def is_der_key(data: bytes) -> bool:
    """A key or certificate over all bytes."""
    return der_key_end(data) == len(data)


def _field(data: bytes, at: int) -> int | None:
    """Where the length-prefixed field at ``at`` ends; None if it doesn't fit."""
    end = at + 4 + int.from_bytes(data[at : at + 4], "big")
    return end if at + 4 <= len(data) and end <= len(data) else None


def ssh_key_end(data: bytes, at: int = 0) -> int | None:
    """Where the OpenSSH key at ``at`` ends, by the fields that it states or has to have; None if there is none.

    A private key that is cut off, and a public one of an unknown algorithm, ends with the data.
    """
    if data.startswith(b"openssh-key-v1\0", at):
        at, cipher = at + 15, b""
        for i in range(3):
            if (end := _field(data, at)) is None:
                return None
            at, cipher = end, cipher if i else data[at + 4 : end]
        n, at = int.from_bytes(data[at : at + 4], "big"), at + 4
        if at > len(data) or not 1 <= n <= 64:
            return None
        for _ in range(n + 1):  # the public keys, then all private ones
            if (at := _field(data, at)) is None:
                return len(data)
        return min(at + _TAGS.get(cipher, 0), len(data))
    if (end := _field(data, at)) is None or not ALGORITHM.fullmatch(name := data[at + 4 : end]):
        return None
    n, need = 1, _FIELDS.get(name, len(data))
    while (next_end := _field(data, end)) is not None and not (n >= need and ALGORITHM.fullmatch(data[end + 4 : min(next_end, end + 259)])):
        n, end = n + 1, next_end
    return end if n >= need or (n >= 2 and end == len(data)) else None


def is_ssh_key(data: bytes) -> bool:
    """An OpenSSH private key, or a public key blob: length-prefixed fields that fill it, an algorithm first."""
    if data.startswith(b"openssh-key-v1\0"):
        data = data[15:]
        at = 0
        for _ in range(3):
            if at + 4 > len(data) or (at := at + 4 + int.from_bytes(data[at : at + 4], "big")) > len(data):
                return False
        return at + 4 <= len(data) and 1 <= int.from_bytes(data[at : at + 4], "big") <= 64
    at, fields = 0, []
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + n > len(data):
            return False
        fields.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return len(fields) >= 2 and bool(ALGORITHM.fullmatch(fields[0]))


def is_pem_key(headers: str, data: bytes) -> bool:
    """A key by its structure, or, where the headers say that it is encrypted, whole blocks of bytes."""
    if ENCRYPTED.search(headers):
        return len(data) >= 4 * _BLOCK and len(data) % _BLOCK == 0
    return is_der_key(data) or is_ssh_key(data)


def is_signed_token(token: str) -> bool:
    """Three parts, the first a JSON object that names an algorithm, the second a JSON object."""
    try:
        head, body = (json.loads(base64.urlsafe_b64decode(x + "=" * (-len(x) % 4))) for x in token.split(".")[:2])
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(body, dict)


def _decoded(x: str) -> bytes:
    try:
        x = re.sub(r"\s", "", x).rstrip("=")
        return base64.b64decode(x + "=" * (-len(x) % 4), validate=True)
    except (binascii.Error, ValueError):
        return b""


def _base64_keys(text: str, starts: re.Pattern, key_end: Callable[[bytes, int], int | None], least: int) -> Iterator[tuple[int, int]]:
    """(start, end) of keys in base64, over lines, that ``key_end`` confirms from a start on.

    A key ends where its own lengths say; at least so many letters have to be its own, unless no others follow.
    """
    run_end = done = 0
    for m in starts.finditer(text):
        if m.start() < done:
            continue
        if m.start() >= run_end:
            run_end = RUN.match(text, m.start()).end()
            at = [x.start() for x in LETTER.finditer(text, m.start(), run_end)]
            decoded: dict[int, bytes] = {}
        i = bisect_left(at, m.start())
        if (k := i % 4) not in decoded:  # once for all starts of a run, which lie at any of four places in a group of letters
            n = len(at) - k
            decoded[k] = _decoded("".join([text[x] for x in at[k : len(at) - (n % 4 == 1)]]))
        if (end := key_end(decoded[k], first := i // 4 * 3)) is None:
            continue
        j = i + (4 * (end - first) + 2) // 3
        if j - i >= least or j == len(at):
            done = at[j - 1] + 1
            if j == len(at) and (j - i) % 4 and (padding := PADDING.match(text, done)):
                done = padding.end()
            yield m.start(), done


def confirmed_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of candidates whose decoded structure holds."""
    out = []
    if "-----BEGIN " in text:
        out += [(m.start(), "pem", m.end()) for m in PEM.finditer(text) if is_pem_key(m[2], _decoded(m[3]))]
    if "eyJ" in text:
        out += [(m.start(), "jwt", m.end()) for m in JWT.finditer(text) if is_signed_token(m[0])]
    out += [(a, "der", b) for a, b in _base64_keys(text, DER, der_key_end, _LEAST)]
    if "AAAA" in text or "b3BlbnNzaC1rZXkt" in text:
        out += [(a, "ssh", b) for a, b in _base64_keys(text, SSH, ssh_key_end, 0)]
    if "30" in text:
        out += [(m.start(), "der", m.end()) for m in HEX_DER.finditer(text) if len(m[0]) % 2 == 0 and is_der_key(bytes.fromhex(m[0]))]
    return out


def in_order(spans: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[1]), s[2]))


def joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


_FOUND = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column("text").to_pylist():
            base = in_order(base_spans(text or ""))
            kinds = [s[1] for s in base]
            rows.append((kinds.count("assign"), kinds.count("access"), kinds.count("hex"), hashlib.sha256(joined(base).encode()).hexdigest(), joined(in_order([*base, *confirmed_spans(text or "")]))))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        arrays = [pa.array(c, pa.int64() if i < 3 else pa.string()) for i, c in enumerate(columns)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=[batch.schema.names[0], "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def scan(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per document: counts of the base patterns, their digest, and all spans as text.

    Spans are kind:start:end in code points, the end exclusive, by start and then kind. Null
    and empty texts have no spans. Rows are independent: repeated or null keys are kept as they
    are, other columns are ignored, and an empty table gives no rows.
    """
    kind = documents.schema[key].dataType.simpleString()
    documents = R.columns(documents, key, "text")
    return R.arrow_map(documents.select(key, "text"), _scan, f"`{key}` {kind}, {_FOUND}")


def redacted(text: str, mark: str = "[SECRET]") -> str:
    """The text with all spans, merged where they touch, replaced by a mark."""
    spans = sorted((a, b) for a, _, b in [*base_spans(text), *confirmed_spans(text)])
    out, at, end = [], 0, -1
    for a, b in spans:
        if a > end:
            if end >= 0:
                out.append(mark)
                at = end
            out.append(text[at:a])
            end = b
        else:
            end = max(end, b)
    if end >= 0:
        out.append(mark)
        at = end
    return "".join([*out, text[at:]])


def redact(documents: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """The same rows and columns with secrets in ``text`` replaced, and ``length`` set anew where it changed.

    Documents without secrets, and null texts, stay as they are.
    """
    names = documents.columns
    at, size = names.index(text), names.index(length) if length in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old = batch.column(at).to_pylist()
            new = [x and redacted(x) for x in old]
            columns = list(batch.columns)
            columns[at] = pa.array(new, batch.schema.field(at).type)
            if size is not None:
                columns[size] = pa.array([n if a == b else len(b) for a, b, n in zip(old, new, columns[size].to_pylist(), strict=True)], batch.schema.field(size).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return R.same_columns(documents, run)
