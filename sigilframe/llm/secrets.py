"""Secrets in texts: fixed patterns, and encodings confirmed by their structure.

Method.  Three base patterns report assignments, access ids and long hex runs.  Beyond these, runs of
base64 or hex are decoded and reported only if the bytes parse as a private key (DER with nested
lengths that fill their parents exactly, or the length-prefixed fields of an OpenSSH key), and dotted
triples only if header and payload decode to the JSON objects of a signed token.  Both base64 alphabets
count.  Line ends inside a key may be real or escaped (backslash and n), and string quotes may close and
open again around them; without a PEM header the lines are joined, up to the length that the key's first
bytes tell.

One narrow pass over the rows: no shuffle, and memory follows the longest text.  Regular expressions
run only on texts that hold a keyword or a word long enough, which no match can do without.

Defined results.  Null and empty texts have no spans and the digest of the empty string.  Spans count
code points, end exclusive; they may overlap across kinds and repeat nothing within a kind.  Repeated
rows and null ids are returned as they come.  An empty table gives an empty table.
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

from .text import word_blocks

KINDS = ("assign", "access", "hex", "key", "token")
BASE = KINDS[:3]

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
#: What may stand between two lines of a key: line ends, real or escaped, blanks, signs of quoting, and string quotes.
_BREAK = r"""(?:\\+[nrt]|[\x20\x09-\x0D"'>,#*|\\]|(?<=["'\x20\x09])\+(?=["'\x20\x09-\x0D]))++"""
_BREAKS = re.compile(_BREAK)
_ALPHABETS = ("A-Za-z0-9+/", "A-Za-z0-9_-")
#: Keys begin with a DER sequence or OpenSSH's magic; an escaped line end before them has a letter that is none of theirs.
_BASE64 = [re.compile(rf"(?:(?<![A-Za-z0-9+/])|(?<=\\[nrt]))(?=M[A-P]|b3Bl)[{a}]{{40,}}={{0,2}}") for a in _ALPHABETS]
_LINE = [re.compile(rf"{_BREAK}([{a}]+={{0,2}})") for a in _ALPHABETS]
_ANY_HEX = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){32,}(?![0-9A-Fa-f])")
_TOKEN = re.compile(r"(?<![A-Za-z0-9_.-])([A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*)(?![A-Za-z0-9_-])")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----((?:[A-Za-z0-9+/=]++|" + _BREAK + r")++)-----END \1-----")
#: Bytes of the shortest word that _TOKEN takes, and of the shortest that a key, or a line of one, or a hex run can stand in.
_TOKEN_BYTES, _LONG_BYTES = 12, 32
_KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")


#: Object identifiers of encryption by password begin with these bytes.
_PASSWORD_SCHEMES = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))


def _der(data: bytes, depth: int = 0) -> list[tuple[int, bytes]] | None:
    """The (tag, content) elements that fill ``data`` exactly; None if lengths do not add up."""
    out, i = [], 0
    while i < len(data):
        if i + 2 > len(data) or data[i] & 0x1F == 0x1F:
            return None
        tag, n = data[i], data[i + 1]
        i += 2
        if n & 0x80:
            size = n & 0x7F
            if not 1 <= size <= 4 or i + size > len(data) or data[i] == 0:
                return None
            n = int.from_bytes(data[i : i + size], "big")
            i += size
            if n < 128:
                return None
        if i + n > len(data):
            return None
        out.append((tag, data[i : i + n]))
        i += n
    return out


def _is_der_key(data: bytes) -> bool:
    outer = _der(data) if data[:1] == b"\x30" else None
    if not outer or len(outer) != 1 or not (parts := _der(outer[0][1])):
        return False
    tags = [t for t, _ in parts]
    if tags == [0x30, 0x04]:  # an encrypted key: a scheme of encryption by password, and what it gave
        scheme = _der(parts[0][1])
        return bool(scheme) and scheme[0][0] == 0x06 and scheme[0][1].startswith(_PASSWORD_SCHEMES) and len(parts[1][1]) >= 32
    if tags[0] != 0x02 or len(parts[0][1]) != 1:
        return False
    if tags[1:3] == [0x30, 0x04]:  # algorithm and wrapped key
        algorithm = _der(parts[1][1])
        return bool(algorithm) and algorithm[0][0] == 0x06
    if len(tags) >= 6 and set(tags) == {0x02}:  # modulus, exponents, primes
        return all(x for _, x in parts)
    return tags[1:2] == [0x04] and 16 <= len(parts[1][1]) <= 66 and all(t in (0xA0, 0xA1) and _der(x) for t, x in parts[2:])


def _is_ssh_key(data: bytes) -> bool:
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    i = len(magic)
    for k in range(3):  # cipher, derivation, its options
        n = int.from_bytes(data[i : i + 4], "big")
        if i + 4 + n > len(data) or (k < 2 and not data[i + 4 : i + 4 + n].isascii()):
            return False
        i += 4 + n
    return 1 <= int.from_bytes(data[i : i + 4], "big") <= 16


def is_private_key(data: bytes) -> bool:
    return _is_der_key(data) or _is_ssh_key(data)


def _decode64(text: str) -> bytes | None:
    body = text.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _object(text: str):
    data = _decode64(text)
    if data is None:
        return None
    try:
        value = json.loads(data)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def _joined(text: str, first: re.Match, line: re.Pattern) -> int | None:
    """The end of the key that begins with the run ``first``, alone or with the lines after it.

    A DER key tells its length; an OpenSSH key ends with its first line of another width.
    """
    whole = _decode64(first[0])
    if whole and _is_der_key(whole):
        return first.end()
    head = _decode64(first[0][:40]) or b"\0\0"
    ssh = head[0] != 0x30
    if ssh:
        need = len(text)
    else:
        size = head[1] & 0x7F if head[1] & 0x80 else 0
        need = -(-4 * (2 + size + (int.from_bytes(head[2 : 2 + size], "big") if size else head[1])) // 3)
        if need > len(text) - first.start():
            return None
    parts, got, end = [first[0]], len(first[0].rstrip("=")), first.end()
    while got < need and not parts[-1].endswith("=") and (not ssh or len(parts[-1]) == len(parts[0])):
        m = line.match(text, end)
        if not m or (ssh and len(m[1]) > len(parts[0])):
            break
        parts.append(m[1])
        end, got = m.end(), got + len(m[1].rstrip("="))
    data = _decode64("".join(parts))
    if data and (ssh or got == need) and is_private_key(data):
        return end
    return first.end() if whole and is_private_key(whole) else None


def _structural(text: str, long: bool, short: bool) -> set[tuple[int, int, int]]:
    found = set()
    key, token = KINDS.index("key"), KINDS.index("token")
    if long:
        for m in _PEM.finditer(text):
            data = _decode64(_BREAKS.sub("", m[2]))
            if data and is_private_key(data):
                found.add((m.start(), key, m.end()))
        pems = sorted(found)
        for pattern, line in zip(_BASE64, _LINE):
            for m in pattern.finditer(text):
                k = bisect.bisect(pems, (m.start(), key, len(text))) - 1
                if k >= 0 and m.start() < pems[k][2]:
                    continue  # the body of a key found already
                end = _joined(text, m, line)
                if end:
                    found.add((m.start(), key, end))
        for m in _ANY_HEX.finditer(text):
            if is_private_key(bytes.fromhex(m[0])):
                found.add((m.start(), key, m.end()))
    for m in _TOKEN.finditer(text) if short else ():
        header = _object(m[1])
        if header and isinstance(header.get("alg"), str) and _object(m[2]) is not None and (m[3] or header["alg"].lower() == "none"):
            found.add((m.start(), token, m.end()))
    return found


def find(text: str, keyword: bool = True, access: bool = True, long: bool = True, short: bool = True) -> list[tuple[int, int, int]]:
    """(start, kind number, end) in order; the flags say what the text can hold at all."""
    found = set()
    if keyword:
        found.update((m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8)
    if access:
        found.update((m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16)
    if long:
        found.update((m.start(), 2, m.end()) for m in _HEX.finditer(text))
    if long or short:
        found |= _structural(text, long, short)
    return sorted(found)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each run of overlapping spans replaced by the name of its first kind."""
    out, done, k = [], 0, 0
    while k < len(spans):
        start, kind, end = spans[k]
        while k + 1 < len(spans) and spans[k + 1][0] < end:
            k += 1
            end = max(end, spans[k][2])
        out += [text[done:start], f"[REDACTED_{KINDS[kind].upper()}]"]
        done, k = end, k + 1
    return "".join(out) + text[done:]


def _scans(texts: pa.Array) -> Iterator[tuple[str | None, list[tuple[int, int, int]]]]:
    for lo, hi, w in word_blocks(texts):
        data = w.buf.tobytes()
        size = w.end - w.start
        longs, shorts = (set(w.text[size >= n].tolist()) for n in (_LONG_BYTES, _TOKEN_BYTES))
        for t in range(hi - lo):
            raw = data[w.offsets[t] : w.offsets[t + 1]]
            low = raw.lower()
            flags = any(k in low for k in _KEYWORDS), b"AKIA" in raw, t in longs or b"PRIVATE KEY-----" in raw, t in shorts and raw.count(b".") > 1
            yield (texts[lo + t].as_py() if any(flags) else None), (find(raw.decode(), *flags) if any(flags) else [])


def _names(spans: list[tuple[int, int, int]], kinds: int = len(KINDS)) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans if k < kinds)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [([sum(k == kind for _, k, _ in spans) for kind in range(len(KINDS))], hashlib.sha256(_names(spans, len(BASE)).encode()).hexdigest(), _names(spans)) for _, spans in _scans(batch.column(1))]
        counts = [pa.array([r[0][k] for r in rows], pa.int64()) for k in range(len(KINDS))]
        yield pa.record_batch([batch.column(0), *counts[:3], pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string()), *counts[3:]], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_key", "n_token"])


def scan(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_key, n_token."""
    return docs.select("doc_id", "text").mapInArrow(_scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_key long, n_token long")


def redacted(docs: DataFrame) -> DataFrame:
    """All columns of ``docs``, with the secrets in ``text`` replaced."""
    at = docs.columns.index("text")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at)
            made = [redact(text, spans) if spans else old.as_py() for old, (text, spans) in zip(texts, _scans(texts))]
            yield batch.set_column(at, batch.schema.field(at).name, pa.array(made, texts.type))

    return docs.mapInArrow(rewrite, docs.schema)
