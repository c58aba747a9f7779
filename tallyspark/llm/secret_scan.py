"""Secret scans: patterns, plus candidates that decode to a key, certificate or signed token."""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import string
import struct
from collections.abc import Iterator
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import whole

#: Kinds in the order of reports; the first three are patterns, the others need confirmed structure.
KINDS = ("assign", "access", "hex", "token", "key", "certificate", "ssh")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")  # runs of 16 characters or more; a shorter run holds no longer one
HEX = re.compile(r"[0-9a-f]{32,}")
DOTTED = re.compile(r"[A-Za-z0-9_.-]+")
ARMOUR = re.compile(r"-----BEGIN ([A-Z0-9 ]{1,40})-----((?:[A-Za-z0-9+/=\s]|\\[rnt])+)-----END \1-----")
#: First characters that the parsers can accept: base64 of a sequence's tag, of a short field's length, of openssh-key-v1; the same in hex.
BASE64 = re.compile(r"M[A-P]|AA|b3Bl")
HEX_HEAD = re.compile(r"30|00|6[Ff]70")
#: A line of a run in each alphabet; lines are joined over line ends, written out or escaped, with their indents.
STANDARD, URLSAFE, DIGITS = (re.compile(rf"[{c}]+") for c in ("A-Za-z0-9+/", "A-Za-z0-9_-", "0-9A-Fa-f"))
BREAK = re.compile(r"[\x20\t]*(?:\r?\n|(?:\\r)?\\n)(?:[\x20\t]|\\t)*")
#: Characters of a run of base64; one before a head means that no run begins there.
INSIDE = string.ascii_letters + string.digits + "+/"
PADDING = re.compile(r"={0,2}")
#: Least characters of a run: a 224-bit elliptic-curve key, the shortest the parsers know, has 47 in base64 and 70 in hex.
LEAST = {STANDARD: 40, URLSAFE: 40, DIGITS: 64}
#: Object identifiers of public-key algorithms: RSA, elliptic curves, Ed25519, X25519.
ALGORITHMS = (bytes.fromhex("2a864886f70d010101"), bytes.fromhex("2a8648ce3d0201"), bytes.fromhex("2b6570"), bytes.fromhex("2b656e"))


def _decode(text: str, urlsafe: bool = False) -> bytes | None:
    text = re.sub(r"\s+|\\[rnt]", "", text).rstrip("=")
    try:
        return base64.b64decode((text.replace("-", "+").replace("_", "/") if urlsafe else text) + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def nested(data: bytes, start: int = 0, stop: int | None = None, depth: int = 0) -> list[tuple[int, bytes | list]] | None:
    """DER values between start and stop as (tag, contents), or None if any length doesn't fit its parent."""
    stop = len(data) if stop is None else stop
    out: list[tuple[int, bytes | list]] = []
    while start < stop:
        if stop - start < 2 or depth > 12:
            return None
        tag, n, at = data[start], data[start + 1], start + 2
        if n >= 0x80:
            width = n & 0x7F
            if not 1 <= width <= 4 or at + width > stop:
                return None
            n, at = int.from_bytes(data[at : at + width], "big"), at + width
            if n < 0x80:
                return None
        if at + n > stop:
            return None
        if tag & 0x20:
            inner = nested(data, at, at + n, depth + 1)
            if inner is None:
                return None
            out.append((tag, inner))
        else:
            out.append((tag, data[at : at + n]))
        start = at + n
    return out


def der_kind(data: bytes) -> str | None:
    """key or certificate, if data is one DER sequence of that shape."""
    tree = nested(data)
    if tree is None or len(tree) != 1 or tree[0][0] != 0x30:
        return None
    parts = tree[0][1]
    tags = [t for t, _ in parts]

    def algorithm(value: bytes | list) -> bool:
        return isinstance(value, list) and bool(value) and value[0][0] == 0x06 and value[0][1] in ALGORITHMS

    if len(parts) >= 9 and set(tags) == {0x02}:
        return "key"  # version and the eight numbers of an RSA private key
    if tags[:3] == [0x02, 0x30, 0x04] and algorithm(parts[1][1]):
        return "key"  # version, algorithm, private key
    if tags[:2] == [0x02, 0x04] and parts[0][1] == b"\x01" and len(parts[1][1]) in (28, 32, 48, 66):
        return "key"  # elliptic-curve private key
    if tags == [0x30, 0x03] and algorithm(parts[0][1]):
        return "key"  # algorithm and public key
    if tags == [0x30, 0x30, 0x03] and len(parts[0][1]) >= 6 and parts[1][1] and parts[1][1][0][0] == 0x06:
        return "certificate"
    return None


def ssh_key(data: bytes) -> bool:
    """Whether data is a public key of length-prefixed fields, or an OpenSSH private key."""
    if data.startswith(b"openssh-key-v1\0"):
        return True
    fields, at = [], 0
    while at < len(data):
        if at + 4 > len(data):
            return False
        (n,) = struct.unpack(">I", data[at : at + 4])
        if at + 4 + n > len(data):
            return False
        fields.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return len(fields) >= 2 and bool(re.fullmatch(rb"(?:ssh|ecdsa|sk)-[a-z0-9@.-]+", fields[0]))


def signed_token(text: str) -> bool:
    """Whether text is a signed token: the header a JSON object that names its algorithm, the claims a JSON object."""
    head, claims, signature = text.split(".")
    try:
        head_, claims_ = (json.loads(_decode(x, urlsafe=True) or b"") for x in (head, claims))
    except (ValueError, RecursionError):
        return False
    if not isinstance(head_, dict) or not isinstance(claims_, dict) or not isinstance(head_.get("alg"), str):
        return False
    return (head_["alg"].lower() == "none") == (not signature) and _decode(signature, urlsafe=True) is not None


def signed_spans(text: str) -> list[tuple[int, int]]:
    """Spans of three parts between dots whose first, from its first eyJ on, could be a header; taken from the left, none overlapping.

    Runs are split once, so time is linear in the text's length.
    """
    out = []
    for run in DOTTED.finditer(text):
        if "eyJ" not in run[0]:
            continue
        parts, at, k = run[0].split("."), run.start(), 0
        while k < len(parts):
            head, used = parts[k].find("eyJ"), 1
            if 0 <= head < len(parts[k]) - 3 and k + 2 < len(parts) and parts[k + 1]:
                used = 3
                out.append((at + head, at + sum(map(len, parts[k : k + 3])) + 2))
            at, k = at + sum(map(len, parts[k : k + used])) + used, k + used
    return out


def joined(text: str, at: int, line: re.Pattern, most: float) -> tuple[str, list[tuple[int, int]]]:
    """The lines of a run from ``at`` until it has ``most`` characters, and each line's end: characters so far, place in the text."""
    parts, stops, n = [], [], 0
    while n < most and (m := line.match(text, at)):
        parts.append(m[0])
        n += len(m[0])
        stops.append((n, m.end()))
        gap = BREAK.match(text, m.end())
        if not gap:
            break
        at = gap.end()
    return "".join(parts), stops


def lengths(data: bytes) -> list[int]:
    """Where the structure that data begins with may end, in bytes: a DER sequence, an OpenSSH private key, length-prefixed fields."""
    if data[:1] == b"\x30" and len(data) > 5:
        width = data[1] & 0x7F if data[1] & 0x80 else 0
        return [2 + width + (int.from_bytes(data[2 : 2 + width], "big") if width else data[1])] if width <= 4 else []
    at, out, private = 0, [], data.startswith(b"openssh-key-v1\0")
    if private:
        at = 15
    fields = 0
    while at + 4 <= len(data):
        n = int.from_bytes(data[at : at + 4], "big")
        fields += 1
        if private and fields == 4:  # the number of public keys, after cipher, derivation and its options
            last, n = 5 + n, 0
        at += 4 + n
        if at > len(data):
            break
        out.append(at)
        if private and fields > 4 and fields == last:
            return [at]
    return [] if private else out[1:]


def structure(text: str, at: int, line: re.Pattern, cut_off: bool) -> tuple[str, int] | None:
    """Kind and end of the key or certificate whose base64 or hex begins at ``at``, on one line or wrapped.

    cut_off: a line that begins an OpenSSH private key counts even where the key doesn't end.
    """
    decode = (lambda x: bytes.fromhex(x[: len(x) // 2 * 2])) if line is DIGITS else (lambda x: _decode(x, urlsafe=line is URLSAFE))
    size = (lambda n: 2 * n) if line is DIGITS else (lambda n: (4 * n + 2) // 3)
    head, _ = joined(text, at, line, LEAST[line])
    start = decode(head[:32]) if len(head) >= LEAST[line] else None
    if not start:
        return None
    der = start[0] == 0x30
    if not der and not start.startswith(b"openssh-key-v1\0") and start[4:7] not in (b"ssh", b"ecd", b"sk-"):
        return None
    most = max(map(size, lengths(start)), default=0) if der else float("inf")
    if der and most > len(text) - at:
        return None
    run, stops = joined(text, at, line, most)
    places = {n // 2 * 2 if line is DIGITS else n: place for n, place in stops}
    ends = lengths(start if der else decode(run[: len(run) - (len(run) % 4 == 1)]))
    for n in reversed(ends):
        if size(n) >= LEAST[line] and size(n) in places:
            data = decode(run[: size(n)])
            kind = data and ("ssh" if ssh_key(data) else der_kind(data))
            if kind:
                return kind, places[size(n)]
    return ("ssh", stops[0][1]) if cut_off and start.startswith(b"openssh-key-v1\0") and stops[0][0] >= LEAST[line] else None


def confirmed(text: str) -> list[tuple[str, int, int]]:
    """Spans whose contents decode to the structure that their kind asks for.

    Candidates are armoured blocks and all runs of base64, URL-safe base64 or hex of LEAST characters
    or more, lines joined, that begin as the parsers' structures do; where a DER or SSH structure ends
    is read from its own lengths, and a line must end there.
    """
    out = [("token", a, b) for a, b in signed_spans(text) if signed_token(text[a:b])] if "eyJ" in text else []
    if "-----BEGIN " in text:
        for m in ARMOUR.finditer(text):
            data = _decode(m[2])
            kind = data and ("ssh" if ssh_key(data) else der_kind(data))
            if kind:
                out.append((kind, m.start(), m.end()))
    for heads, lines, inside in ((BASE64, (STANDARD, URLSAFE), INSIDE), (HEX_HEAD, (DIGITS,), string.hexdigits)):
        for m in heads.finditer(text):
            at = m.start()
            if at and text[at - 1] in inside and text[max(0, at - 2) : at] not in ("\\n", "\\r", "\\t"):
                continue
            if any(a <= at < b for _, a, b in out):
                continue
            for cut_off, line in product((False, True), lines):
                if found := structure(text, at, line, cut_off):
                    out.append((found[0], at, PADDING.match(text, found[1]).end() if line is not DIGITS else found[1]))
                    break
    return out


def patterns(text: str) -> list[tuple[str, int, int]]:
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)] if "AKIA" in text else []
    return out + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def _report(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2])))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_assign, n_access, n_hex, n_confirmed, base_sha256, spans.

    spans lists kind:start:end, in code points, end exclusive, by start and then kind: the patterns'
    spans and those of confirmed structure, whose candidates decode from base64 or hex and whose nested
    lengths, algorithm identifiers, length-prefixed fields or token headers all parse. base_sha256 is
    the hash of the patterns' part alone. One pass, nothing shuffled.

    Null and empty texts have no spans and the hash of an empty list; null ids and repeated rows are
    reported like others; an empty table gives no rows; other columns are ignored.
    """
    schema = "id string, n_assign long, n_access long, n_hex long, n_confirmed long, base_sha256 string, spans string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                text = text.as_py()
                base, more = patterns(text), confirmed(text)
                counts = [sum(k == kind for k, _, _ in base) for kind in KINDS[:3]]
                rows.append((*counts, len(more), hashlib.sha256(_report(base).encode()).hexdigest(), _report(base + more)))
            names = ["n_assign", "n_access", "n_hex", "n_confirmed", "base_sha256", "spans"]
            kinds = [*[pa.int64()] * 4, pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]], names=["id", *names])

    return df.select(F.col(f"`{id_col}`").cast("string").alias("id"), whole(text_col).alias("text")).mapInArrow(run, schema)
