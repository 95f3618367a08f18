"""Secret scans with structural confirmation.

Three patterns give the base findings. Beyond them, runs of base64 or hex digits are candidates
only: each is decoded and its structure parsed - DER with nested lengths that add up and the
shape of a private key, OpenSSH's private container, a signed or encrypted token whose header is JSON with
an algorithm - and is reported only when that succeeds. Public keys, certificates and signatures are not secret.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import small_batches

#: The kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "jwt", "pem", "der", "ssh")

#: Base patterns. The patterns are ASCII, so they run on UTF-8 bytes; runs of hex or
#: access key characters are maximal, so that their least length can stand in the pattern.
ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]{12,}")
HEX = re.compile(rb"[0-9a-f]{32,}")

_JWT = re.compile(rb"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")
_FIVE_PARTS = re.compile(rb"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]{16,})(?![A-Za-z0-9_.-])")
_PEM = re.compile(rb"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----((?:\s*[A-Za-z0-9-]+:[^\n]*\n)*)([A-Za-z0-9+/=\s]+?)-----END \1-----")
_BASE64 = re.compile(rb"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40,}={0,2}")
_NEXT_LINE = re.compile(rb"\r?\n[ \t]*([A-Za-z0-9+/]+={0,2})(?![A-Za-z0-9+/=])")
_HEX_RUN = re.compile(rb"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){24,}(?![0-9A-Fa-f])")

#: Object identifiers, as DER bodies, of key algorithms (RSA, elliptic curve, Ed25519, X25519, DSA, RSA-PSS, Ed448, X448,
#: Diffie-Hellman) and of the encryption of PKCS 8 keys (PBES2, PBES1, PKCS 12).
KEY_OIDS = tuple(
    bytes.fromhex(x)
    for x in (
        *("2a864886f70d010101", "2a8648ce3d0201", "2b6570", "2b656e", "2a8648ce380401", "2a864886f70d01010a", "2b6571", "2b656f", "2a864886f70d010301"),
        *("2a864886f70d01050d", *(f"2a864886f70d0105{n}" for n in ("01", "03", "04", "06", "0a", "0b")), *(f"2a864886f70d010c010{n}" for n in range(1, 7))),
    )
)


def der_items(data: bytes, at: int = 0, end: int | None = None) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the values that fill data[at:end]; None if the lengths don't add up."""
    end = len(data) if end is None else end
    out = []
    while at < end:
        if at + 2 > end:
            return None
        tag, size = data[at], data[at + 1]
        at += 2
        if size >= 128:
            n = size & 127
            if not 1 <= n <= 4 or at + n > end or data[at] == 0:
                return None
            size = int.from_bytes(data[at : at + n], "big")
            if size < 128:
                return None
            at += n
        if at + size > end:
            return None
        out.append((tag, at, at + size))
        at += size
    return out


def is_der_key(data: bytes) -> bool:
    """A sequence that fills the data and has the inner shape of a private key, plain or encrypted."""
    top = der_items(data) if data[:1] == b"\x30" else None
    if not top or len(top) != 1:
        return False
    inner = der_items(data, top[0][1], top[0][2])
    if not inner:
        return False
    tags = [t for t, _, _ in inner]
    if len(tags) >= 9 and set(tags[:9]) == {2}:  # RSA: version, modulus and seven more integers
        return True
    if len(tags) >= 2 and tags[:2] == [2, 4] and inner[0][2] - inner[0][1] == 1 and 16 <= inner[1][2] - inner[1][1] <= 66:
        return True  # elliptic curve: version 1 and the private number
    # PKCS 8: a version, an algorithm, then octets; encrypted it has no version. Bits after an algorithm are a public key
    at = 1 if tags[:1] == [2] else 0
    if tags[at : at + 2] != [0x30, 4]:
        return False
    named = der_items(data, *inner[at][1:])
    return bool(named) and named[0][0] == 6 and data[named[0][1] : named[0][2]] in KEY_OIDS


def is_ssh_key(data: bytes) -> bool:
    """OpenSSH's private container: a cipher, a derivation and its options whose lengths fit, and a number of keys."""
    if not data.startswith(b"openssh-key-v1\x00"):
        return False
    at = 15
    for _ in range(3):
        if at + 4 > len(data):
            return False
        at += 4 + int.from_bytes(data[at : at + 4], "big")
    return at + 4 <= len(data)


def _decoded(run: bytes, url: bool = False) -> bytes:
    run = run.rstrip(b"=")
    try:
        return (base64.urlsafe_b64decode if url else base64.b64decode)(run + b"=" * (-len(run) % 4))
    except (binascii.Error, ValueError):
        return b""


def is_token_header(part: bytes) -> bool:
    try:
        header = json.loads(_decoded(part, url=True))
    except ValueError:
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str)


def is_locked_token(parts: tuple[bytes, ...]) -> bool:
    """Five parts: a header that names how key and content are encrypted, and a nonce and a tag of usual lengths."""
    try:
        header = json.loads(_decoded(parts[0], url=True))
    except ValueError:
        return False
    named = isinstance(header, dict) and isinstance(header.get("alg"), str) and isinstance(header.get("enc"), str)
    return named and len(_decoded(parts[2], url=True)) in (12, 16) and len(_decoded(parts[4], url=True)) in (16, 24, 32)


def base_spans(text: bytes) -> list[tuple[str, int, int]]:
    """(kind, start, end) in bytes."""
    out = []
    if b"=" in text or b":" in text:
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    out += [("access", *m.span()) for m in ACCESS.finditer(text)] if b"AKIA" in text else []
    return out + [("hex", *m.span()) for m in HEX.finditer(text)]


def _wrapped(text: bytes, first: re.Match) -> list[tuple[bytes, int]]:
    """(joined digits, end) of a run and the lines after it: lines of its width and a last one that may be shorter; the longest first."""
    lines, end, out = [first[0]], first.end(), [(first[0], first.end())]
    while not lines[-1].endswith(b"=") and (m := _NEXT_LINE.match(text, end)) and len(m[1]) <= len(first[0]):
        lines.append(m[1])
        end = m.end()
        if len(m[1]) < len(first[0]):
            out.append((b"".join(lines[:-1]), m.start()))
            break
    return [(b"".join(lines), end), *reversed(out)]


def confirmed_spans(text: bytes) -> list[tuple[str, int, int]]:
    """Candidates of the text whose decoded structure is that of a key or a signed token."""
    out = []
    if b"eyJ" in text:
        out += [("jwt", *m.span()) for m in _JWT.finditer(text) if is_token_header(m[1]) and _decoded(m[2], url=True)[:1] == b"{"]
        out += [("jwt", *m.span()) for m in _FIVE_PARTS.finditer(text) if is_locked_token(m.groups())]
    if b"PRIVATE KEY-----" in text:
        for m in _PEM.finditer(text):
            body = _decoded(b"".join(m[3].split()))
            # a body under Proc-Type and DEK-Info is the output of a block cipher
            locked = b"ENCRYPTED" in m[2] and b"DEK-Info:" in m[2] and len(body) >= 16 and len(body) % 8 == 0
            if locked or is_der_key(body) or is_ssh_key(body):
                out.append(("pem", *m.span()))
    for m in _BASE64.finditer(text):
        kind, check = ("der", is_der_key) if m[0][:1] == b"M" else ("ssh", is_ssh_key)  # 0x30 is M in base64
        if kind == "der" or m[0][:12] == b"b3BlbnNzaC1r":
            ends = _wrapped(text, m)
            found = next((end for run, end in ends if check(_decoded(run))), None)
            if found is not None:
                out.append((kind, m.start(), found))
    for m in _HEX_RUN.finditer(text):
        if m[0][:2] == b"30" and is_der_key(bytes.fromhex(m[0].decode())):
            out.append(("der", *m.span()))
    return out


def _code_points(text: bytes, spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Byte offsets turned into offsets of code points, sorted by start and kind."""
    if not text.isascii():
        points, at, n = {}, 0, 0
        for x in sorted({p for s in spans for p in s[1:]}):
            n += len(text[at:x].decode("utf-8", "ignore"))
            points[x], at = n, x
        spans = [(k, points[a], points[b]) for k, a, b in spans]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def find_spans(text: str | bytes | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans and all spans of a text, in code points, end exclusive."""
    data = text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass")
    base = base_spans(data)
    more = confirmed_spans(data)
    if not base and not more:
        return [], []
    return _code_points(data, base), _code_points(data, base + more)


_SPANS = "array<struct<kind:string,start:long,end:long>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        base, every = [], []
        at = batch.schema.get_field_index("text")
        for text in batch.column(at).cast(pa.large_string()).cast(pa.large_binary()):
            a, b = find_spans(text.as_py() or b"")
            base.append([dict(zip(("kind", "start", "end"), s, strict=True)) for s in a])
            every.append([dict(zip(("kind", "start", "end"), s, strict=True)) for s in b])
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        columns = [c for n, c in enumerate(batch.columns) if batch.schema.names[n] not in ("base_spans", "spans")]
        names = [n for n in batch.schema.names if n not in ("base_spans", "spans")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(base, kind), pa.array(every, kind)], [*names, "base_spans", "spans"])


def scan(docs: DataFrame) -> DataFrame:
    """``docs`` with ``base_spans`` and ``spans``, arrays of (kind, start, end) in code points.

    A null text is empty and has none, null ids stay, very long texts are scanned whole; spans of one start are listed by kind. All other columns stay (these two are replaced); equal rows
    get equal spans; an empty table stays empty. One pass without a shuffle: a lost executor's
    tasks are run again on their part of the input.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("base_spans", "spans")
    found = T.StructType.fromDDL(f"base_spans {_SPANS}, spans {_SPANS}")
    return docs.mapInArrow(_scan, T.StructType([*docs.schema.fields, *found.fields]))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.schema.names
        texts = batch.column(names.index("text"))
        out = []
        for text in texts:
            text = text.as_py()
            for a, b in reversed(union_of(find_spans(text)[1])):
                text = f"{text[:a]}[SECRET]{text[b:]}"
            out.append(text)
        new = pa.array(out, texts.type)
        yield batch.set_column(names.index("text"), batch.schema.field("text"), new)


def union_of(spans: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for _, a, b in sorted(spans, key=lambda s: s[1:]):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each span of the text replaced by ``[SECRET]``; overlapping spans are one.

    Texts without spans, null ones among them, and all other columns stay as they are, whatever their names; equal rows
    stay equal, very long texts are scanned whole, an empty table stays empty.
    """
    small_batches(docs.sparkSession)
    return docs.mapInArrow(_redact, docs.schema)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("text")

    def of(kind: str) -> Column:
        return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [of(kind) for kind in ("assign", "access", "hex")]
    return found.select(
        "doc_id", *counts, F.sha2(_joined(F.col("base_spans")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans")
    )
