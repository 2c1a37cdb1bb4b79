"""Secrets in texts: keyword automaton, anchored patterns near its hits, embedded checksums.

An Aho-Corasick automaton finds the keywords of all kinds in one pass over a text. Only at
a hit is the pattern of its kind tried, anchored there. Kinds whose tokens carry a checksum
are kept only if it is right. Runs of hexadecimal digits have no keyword; a plain pattern
finds them.

Defined cases: a null text is an empty one and has no spans. Texts are read whole, whatever
their length. Repeated rows give repeated results. Spans are code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The patterns of the kinds.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
GITHUB = re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
NPM = re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
}
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

KINDS = ("assign", "access", "hex", "github", "npm")
BASE_KINDS = KINDS[:3]
PATTERNS = {"assign": ASSIGN, "access": ACCESS, "github": GITHUB, "npm": NPM}
ASCII_LOWER = {upper: upper + 32 for upper in range(ord("A"), ord("Z") + 1)}

Span = tuple[str, int, int]


def base62_checksum(text: str) -> str:
    """CRC-32 of the text as six base-62 digits."""
    value, digits = zlib.crc32(text.encode()), ""
    while value:
        value, digit = divmod(value, 62)
        digits = BASE62[digit] + digits
    return digits.rjust(6, "0")


def _accepted(kind: str, match: re.Match) -> bool:
    if kind == "assign":
        return len(match[2]) >= 6
    if kind == "access":
        return len(match[0]) >= 20
    return base62_checksum(match[1]) == match[2]


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for word in words:
            automaton.add_word(word, (kind, len(word)))
    automaton.make_automaton()
    return automaton


def _lowered(text: str) -> str:
    """The text in lower case, position by position."""
    lower = text.lower()
    return lower if len(lower) == len(text) else text.translate(ASCII_LOWER)


def find_secrets(text: str) -> list[Span]:
    """All spans, by start, then in the order of the kinds."""
    hits = sorted((end + 1 - size, kind) for end, (kind, size) in _automaton().iter(_lowered(text)))
    spans = [("hex", found.start(), found.end()) for found in HEX.finditer(text)]
    done = dict.fromkeys(PATTERNS, 0)
    for start, kind in hits:
        # A match takes its characters even if it is not accepted.
        if start >= done[kind] and (match := PATTERNS[kind].match(text, start)):
            done[kind] = match.end()
            if _accepted(kind, match):
                spans.append((kind, start, match.end()))
    return sorted(spans, key=lambda span: (span[1], KINDS.index(span[0])))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def scan_secrets(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, ``spans`` (kind, start, end) in order."""
    source = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    id_type = pa.int64() if dict(source.dtypes)["doc_id"] == "bigint" else None
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                [dict(zip(("kind", "start", "end"), span)) for span in find_secrets(text.as_py() or "")]
                for text in batch.column("text")
            ]
            ids = batch.column("doc_id")
            yield pa.RecordBatch.from_arrays(
                [ids if id_type is None else ids.cast(id_type), pa.array(found, pa.list_(span))], ["doc_id", "spans"]
            )

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(scan, f"doc_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def secret_digests(found: DataFrame) -> DataFrame:
    """Counts by kind and digests of the spans of :func:`scan_secrets`."""

    def text_of(spans):
        return F.array_join(
            F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
        )

    def count_of(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select(
        "doc_id",
        *[count_of(kind).alias(f"n_{kind}") for kind in KINDS],
        F.sha2(text_of(base), 256).alias("base_sha256"),
        text_of(F.col("spans")).alias("spans"),
    )


def span_digest(spans: list[Span]) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()
