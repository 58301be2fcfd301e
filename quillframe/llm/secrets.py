"""Secret scan with structural confirmation.

Candidates are runs of base64, base64url, hex or base32 characters. A candidate is reported only when its decoded bytes
have the structure of a credential:

* ``rsa_private_key``, ``pkcs8_private_key``, ``ec_private_key``, ``encrypted_private_key``: DER whose nested lengths add
  up exactly and whose fields are those of the encoding (PKCS#1, PKCS#8 with the key that its algorithm calls for inside,
  SEC 1), in a PEM block, bare base64, whole or wrapped over lines, or hex;
* ``openssh_private_key``: the OpenSSH container, all of whose length-prefixed fields fit;
* ``signed_token``: a header and a payload of JSON objects, the header naming an algorithm and the signature having
  the length that this algorithm gives;
* ``access_key_id``: a four-letter prefix of a cloud access key followed by 16 base32 characters (10 whole bytes);
* ``hex_key``, ``base64_key``: an opaque key, which has no inner structure and is reported apart, with structural false: it
  must be assigned to a name that says so, decode to 8 to 64 whole bytes and look random (enough distinct symbols and
  bytes, digits as well as letters).

What is reported is the kind, the place (in characters), the decoded size, what the structure says and a SHA-256 prefix;
never the secret itself. Texts without any candidate never leave the JVM.

Defined results: null and empty texts give nothing; repeated rows are each reported; a secret inside another (a token
in a PEM block) is reported once, as the outer one, and of two that overlap the kind listed first wins; a very long text is
scanned whole, in time linear in its length; extra columns are ignored; an empty table gives an empty result.
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
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

NAMES = r"(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth|credential|private[_-]?key|client[_-]?secret|signing[_-]?key)"
ASSIGNED = rf"(?i:{NAMES}[a-z0-9_]{{0,40}})[\"']?\s{{0,4}}(?::=|=>|[=:])\s{{0,4}}[\"']?"
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40}PRIVATE KEY)-----((?:[A-Za-z0-9+/=\s\\,:.]|-(?!----))*)-----END \1-----")
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*)(?![A-Za-z0-9_-])")
#: From 23 bytes on, a SEC 1 key of 16 bytes without parameters, the shortest that parse_der confirms.
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/]{31,}|[A-Za-z0-9_-]{31,})={0,2}(?![A-Za-z0-9+/_=-])")
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/]{40,76}(?:\r?\n[ \t]{0,16}[A-Za-z0-9+/]{40,76})*(?:\r?\n[ \t]{0,16}[A-Za-z0-9+/]{2,76}={0,2})(?![A-Za-z0-9+/=_-])")
HEX = re.compile(r"(?<![0-9A-Za-z])(?:[0-9a-f]{2}){23,}(?![0-9A-Za-z])|(?<![0-9A-Za-z])(?:[0-9A-F]{2}){23,}(?![0-9A-Za-z])")
ACCESS = re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA|AROA|AIDA)([A-Z2-7]{16})(?![A-Za-z0-9])")
OPAQUE = re.compile(ASSIGNED + r"([A-Za-z0-9+/_-]{16,128}={0,2})(?![A-Za-z0-9+/_=-])")
#: Java pattern that every text with a candidate matches.
ANY = rf"PRIVATE KEY-----|[A-Za-z0-9+/_-]{{31}}|(?:AKIA|ASIA|AROA|AIDA)[A-Z2-7]{{16}}|[A-Za-z0-9_-]{{8,}}\.[A-Za-z0-9_-]{{2,}}\.|(?i:{NAMES})[A-Za-z0-9_]{{0,40}}[\"']?\s{{0,4}}(?::=|=>|[=:])"
SIGNATURES = {"HS256": (32, 32), "HS384": (48, 48), "HS512": (64, 64), "ES256": (64, 64), "ES256K": (64, 64), "ES384": (96, 96), "ES512": (132, 132), "EdDSA": (64, 114)} | {a + n: (128, 1024) for a in ("RS", "PS") for n in ("256", "384", "512")}


def _base64(text: str) -> bytes | None:
    clean = text.rstrip("=").translate(str.maketrans("-_", "+/"))
    if len(clean) % 4 == 1:
        return None
    try:
        return base64.b64decode(clean + "=" * (-len(clean) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _tlv(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, start, stop) of the DER value at a place, None where the length isn't minimal or doesn't fit."""
    if at + 2 > end:
        return None
    tag, size, at = data[at], data[at + 1], at + 2
    if size == 0x80:
        return None
    if size > 0x80:
        n = size & 0x7F
        if n > 4 or at + n > end or data[at] == 0:
            return None
        size, at = int.from_bytes(data[at : at + n], "big"), at + n
        if size < 0x80:
            return None
    return (tag, at, at + size) if at + size <= end else None


def _children(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """The values that fill the span exactly, None if they don't."""
    out = []
    while at < end:
        value = _tlv(data, at, end)
        if value is None:
            return None
        out.append(value)
        at = value[2]
    return out


def _is_nested(data: bytes, at: int, end: int, depth: int = 0) -> bool:
    """Whether all constructed values in the span nest by their lengths."""
    found = _children(data, at, end)
    return found is not None and depth < 12 and all(not tag & 0x20 or _is_nested(data, a, b, depth + 1) for tag, a, b in found)


def parse_der(data: bytes) -> tuple[str, str] | None:
    """(kind, detail) of a private key's DER encoding."""
    top = _tlv(data, 0, len(data))
    if top is None or top[0] != 0x30 or top[2] != len(data) or not _is_nested(data, 0, len(data)):
        return None
    parts = _children(data, top[1], top[2]) or []
    tags = [p[0] for p in parts]
    whole = [int.from_bytes(data[a:b], "big") if tag == 0x02 and b > a else None for tag, a, b in parts]
    if len(tags) >= 9 and tags[:9] == [0x02] * 9 and whole[0] in (0, 1) and (whole[1] or 0).bit_length() >= 256 and (whole[2] or 0) % 2 and (whole[2] or 0) > 1 and whole[4] and whole[5] and whole[4] * whole[5] == whole[1]:
        return "rsa_private_key", f"modulus {whole[1].bit_length()} bits"
    if len(tags) >= 3 and tags[:3] == [0x02, 0x30, 0x04] and whole[0] in (0, 1):
        algorithm = _children(data, parts[1][1], parts[1][2])
        if algorithm and algorithm[0][0] == 0x06 and all(t in (0xA0, 0x81, 0xA1) for t in tags[3:]):
            oid = _oid(data[algorithm[0][1] : algorithm[0][2]])
            if _inner_key(oid, data[parts[2][1] : parts[2][2]]):
                return "pkcs8_private_key", f"algorithm {oid}"
    if len(tags) >= 2 and tags[:2] == [0x02, 0x04] and whole[0] == 1 and 16 <= parts[1][2] - parts[1][1] <= 72 and all(t in (0xA0, 0xA1) for t in tags[2:]):
        return "ec_private_key", f"{8 * (parts[1][2] - parts[1][1])} bits"
    if tags == [0x30, 0x04]:
        algorithm = _children(data, parts[0][1], parts[0][2])
        if algorithm and algorithm[0][0] == 0x06 and _oid(data[algorithm[0][1] : algorithm[0][2]]).startswith(("1.2.840.113549.1.5.", "1.2.840.113549.1.12.")):
            return "encrypted_private_key", f"algorithm {_oid(data[algorithm[0][1] : algorithm[0][2]])}"
    return None


#: Bytes of the keys on Edwards and Montgomery curves, by algorithm.
CURVE_KEYS = {"1.3.101.110": 32, "1.3.101.111": 56, "1.3.101.112": 32, "1.3.101.113": 57}


def _inner_key(oid: str, data: bytes) -> bool:
    """Whether the octets inside a PKCS#8 key are what its algorithm calls for."""
    top = _tlv(data, 0, len(data))
    if top is None or top[2] != len(data):
        return False
    if oid in ("1.2.840.113549.1.1.1", "1.2.840.113549.1.1.10"):
        found = parse_der(data)
        return found is not None and found[0] == "rsa_private_key"
    if oid == "1.2.840.10045.2.1":
        found = parse_der(data)
        return found is not None and found[0] == "ec_private_key"
    if oid in CURVE_KEYS:
        return top[0] == 0x04 and top[2] - top[1] == CURVE_KEYS[oid]
    return oid in ("1.2.840.10040.4.1", "1.2.840.113549.1.3.1", "1.2.840.10046.2.1") and top[0] == 0x02 and top[2] - top[1] >= 16


def _oid(data: bytes) -> str:
    out, value = [], 0
    for b in data:
        value = value << 7 | b & 0x7F
        if not b & 0x80:
            out += [min(value // 40, 2), value - 40 * min(value // 40, 2)] if not out else [value]
            value = 0
    return ".".join(map(str, out))


def parse_openssh(data: bytes) -> tuple[str, str] | None:
    """(kind, detail) of an OpenSSH private key container."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return None
    at, fields = len(magic), []

    def take() -> bytes | None:
        nonlocal at
        if at + 4 > len(data):
            return None
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            return None
        at += 4 + size
        return data[at - size : at]

    for _ in range(3):
        fields.append(take())
    if None in fields or at + 4 > len(data):
        return None
    keys, at = int.from_bytes(data[at : at + 4], "big"), at + 4
    public = [take() for _ in range(min(keys, 16))]
    private = take()
    if not 1 <= keys <= 16 or None in public or not private or at != len(data):
        return None
    if fields[0] == b"none" and (len(private) < 8 or private[:4] != private[4:8]):  # the check number stands there twice
        return None
    size = int.from_bytes(public[0][:4], "big")
    return "openssh_private_key", f"{public[0][4 : 4 + size].decode('ascii', 'replace')}, cipher {fields[0].decode('ascii', 'replace')}"


def parse_token(head: str, body: str, signature: str) -> tuple[int, str] | None:
    """(decoded bytes, detail) of a signed token."""
    parts = [_base64(x) for x in (head, body, signature)]
    if None in parts:
        return None
    try:
        header, payload = json.loads(parts[0]), json.loads(parts[1])
    except (ValueError, RecursionError):
        return None
    if not isinstance(header, dict) or not isinstance(payload, dict) or not isinstance(header.get("alg"), str):
        return None
    low, high = SIGNATURES.get(header["alg"], (None, None))
    return (sum(map(len, parts)), f"alg {header['alg']}") if low is not None and low <= len(parts[2]) <= high else None


def _parse(data: bytes | None) -> tuple[str, str] | None:
    return None if data is None else parse_der(data) or parse_openssh(data)


def _opaque(text: str) -> tuple[str, int] | None:
    """(kind, decoded bytes) of a key without structure."""
    digits, letters = any(c.isdigit() for c in text), any(c.isalpha() for c in text)
    if re.fullmatch(r"(?:[0-9a-f]{2})+|(?:[0-9A-F]{2})+", text):
        data = bytes.fromhex(text)
        random = len(set(text.lower())) >= 6 and len(set(data)) * 2 > len(data)
        return ("hex_key", len(data)) if digits and letters and random and 8 <= len(data) <= 64 else None
    data = _base64(text)
    if data is None or not 12 <= len(data) <= 64 or not digits or len(set(text)) < min(14, len(text) * 6 // 10):
        return None
    mixed = any(c.isupper() for c in text) and any(c.islower() for c in text)
    plain = sum(32 <= b < 127 for b in data) / len(data)  # words decode to bytes anywhere, text in base64 to plain ones
    return ("base64_key", len(data)) if mixed and plain < 0.9 else None


def scan(text: str) -> list[tuple[str, int, int, int, str, str]]:
    """(kind, start, end, decoded bytes, detail, fingerprint) of each confirmed secret, by start."""
    found: list[tuple[str, int, int, int, str, str]] = []
    taken: list[tuple[int, int]] = []  # disjoint, in order

    def add(kind: str, start: int, end: int, size: int, detail: str) -> None:
        at = bisect.bisect_left(taken, (start, end))
        if (at == 0 or taken[at - 1][1] <= start) and (at == len(taken) or end <= taken[at][0]):
            taken.insert(at, (start, end))
            found.append((kind, start, end, size, detail, hashlib.sha256(text[start:end].encode("utf-8", "replace")).hexdigest()[:16]))

    for m in PEM.finditer(text):
        lines = [x for x in m[2].replace("\\n", "\n").split("\n") if ":" not in x]
        data = _base64(re.sub(r"\s", "", "".join(lines)))
        kind = _parse(data)
        if kind:
            add(kind[0], m.start(), m.end(), len(data), kind[1])
        elif data and "ENCRYPTED" in m[2] and len(data) % 8 == 0:
            add("encrypted_private_key", m.start(), m.end(), len(data), "legacy PEM cipher")
    for m in TOKEN.finditer(text):
        token = parse_token(m[1], m[2], m[3])
        if token:
            add("signed_token", m.start(), m.end(), *token)
    for m in BASE64.finditer(text):
        data = _base64(m[0])
        kind = _parse(data)
        if kind:
            add(kind[0], m.start(), m.end(), len(data), kind[1])
    for m in WRAPPED.finditer(text):
        data = _base64(re.sub(r"\s", "", m[0]))
        kind = _parse(data)
        if kind:
            add(kind[0], m.start(), m.end(), len(data), kind[1])
    for m in HEX.finditer(text):
        data = bytes.fromhex(m[0])
        kind = _parse(data)
        if kind:
            add(kind[0], m.start(), m.end(), len(data), kind[1])
    for m in ACCESS.finditer(text):
        if len(set(m[1])) >= 6:
            add("access_key_id", m.start(), m.end(), len(base64.b32decode(m[1])), f"prefix {m[0][:4]}")
    for m in OPAQUE.finditer(text):
        kind = _opaque(m[1])
        if kind:
            add(kind[0], m.start(1), m.end(1), kind[1], "assigned to a credential's name")
    return sorted(found, key=lambda x: x[1])


def find_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, start, end, n_bytes, detail, fingerprint, structural) of every secret; structural is false for opaque keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(doc_id, *x) for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()) for x in scan(text)]
            columns = list(zip(*rows)) or [()] * 7
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "kind", "start", "end", "n_bytes", "detail", "fingerprint"])

    hits = common.need(docs, "doc_id", "text").filter(F.col("text").rlike(ANY))
    found = hits.mapInArrow(run, "doc_id long, kind string, start int, end int, n_bytes int, detail string, fingerprint string")
    return found.withColumn("structural", ~F.col("kind").isin("hex_key", "base64_key"))


def opquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
