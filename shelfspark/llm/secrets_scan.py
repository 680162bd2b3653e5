"""Secret scan: pattern rules, and strings that a tiktoken vocabulary encodes badly.

Ordinary words and identifiers are covered by long vocabulary entries; random strings
fall apart into pieces of one or two characters. A string with few characters per token
is therefore reported, unless it is a number, a digest, a UUID, or an identifier whose parts
are all words or pieces that the vocabulary encodes well.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm.common import slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed: the pre-splitting pattern published with the vocabulary.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: Kinds in reporting order; the last is the token-efficiency test.
KINDS = ("assign", "access", "hex", "random")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_LONG = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}+")
_UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_DIGEST = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)")
#: Hex digits of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512 digests.
DIGEST_LENGTHS = frozenset({32, 40, 56, 64, 96, 128})
_PIECE = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_IDENTIFIER = re.compile(r"[A-Za-z]+\d{0,4}")
_KEYWORDS = ("passw", "secret", "token", "api")


@dataclass(frozen=True)
class TokenTest:
    """A string is random if it has fewer characters per token than ``max_chars_per_token``."""

    max_chars_per_token: float = 1.9
    min_length: int = 16


def load_ranks(spark: SparkSession, path: str = VOCABULARY) -> dict[bytes, int]:
    """Merge ranks of a ``.tiktoken`` file (bounded by the vocabulary), read by the driver."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _encoding(ranks: dict[bytes, int]):
    import tiktoken
    return tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the pattern rules: leftmost, non-overlapping per kind."""
    out = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        out += [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], x[2]))


def is_fixed(s: str) -> bool:
    """Digests, UUIDs and plain numbers: never reported as random."""
    return bool(s.isdigit() or _UUID.fullmatch(s) or (len(s) in DIGEST_LENGTHS and _DIGEST.fullmatch(s)))


def is_known(s: str) -> bool:
    """Fixed kinds, and strings with the shape of a name (``has_known_parts`` tests what it is made of)."""
    if is_fixed(s):
        return True
    parts = [p for p in re.split(r"[+/_=-]+", s) if p]
    return all(_IDENTIFIER.fullmatch(p) and (p.islower() or p.isupper() or p.istitle() or _camel(p)) or p.isdigit()
               for p in parts)


def _camel(s: str) -> bool:
    """Humps of three letters or more on average."""
    return len(s) >= 3 * (1 + sum(c.isupper() for c in s[1:])) and not any(c.isdigit() for c in s)


def has_known_parts(s: str, encoding, test: TokenTest) -> bool:
    """Every word of an identifier is one token or reaches the characters per token, in its
    own or lower case, with or without a space before it."""
    for p in _PIECE.findall(s):
        tokens = min(len(encoding.encode_ordinary(v)) for v in {p, f" {p}", p.lower(), f" {p.lower()}"})
        if tokens > 1 and len(p) < test.max_chars_per_token * tokens:
            return False
    return True


def random_spans(text: str, encoding, test: TokenTest) -> list[tuple[int, int, int]]:
    out = []
    for m in _LONG.finditer(text):
        s = m.group()
        if len(s) >= test.min_length and not is_fixed(s):
            if len(s) < test.max_chars_per_token * len(encoding.encode_ordinary(s)):
                if not (is_known(s) and has_known_parts(s, encoding, test)):
                    out.append((m.start(), m.end(), 3))
    return out


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY,
         test: TokenTest = TokenTest()) -> DataFrame:
    """One row per document: n_assign, n_access, n_hex, base_sha256, spans, n_random.

    Spans are ``kind:start:end`` in code points, end exclusive, by start and then kind,
    comma-joined; ``base_sha256`` is the digest of the pattern rules' spans alone. A
    random string that meets a pattern's span is that span, so it is not added. Null and
    empty texts have no spans (digest of the empty string). Rows are scanned one by one:
    repeated rows repeat, null ids stay, other columns are not read.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(docs.sparkSession, vocabulary))
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    names = ["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = None
        for b in slices(batches, "text"):
            encoding = encoding or _encoding(ranks.value)
            rows = []
            for t in b.column("text").to_pylist():
                base = base_spans(t or "")
                more = [r for r in random_spans(t or "", encoding, test)
                        if not any(s < r[1] and r[0] < e for s, e, _ in base)]
                kinds = [k for _, _, k in base]
                rows.append((kinds.count(0), kinds.count(1), kinds.count(2),
                             hashlib.sha256(_joined(base).encode()).hexdigest(),
                             _joined(sorted(base + more, key=lambda x: (x[0], x[2]))), len(more)))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), *[pa.array(cols[i], pa.int64()) for i in range(3)], pa.array(cols[3], pa.string()),
                 pa.array(cols[4], pa.string()), pa.array(cols[5], pa.int64())], names)

    schema = (f"id {narrow.schema['id'].dataType.simpleString()}, n_assign bigint, n_access bigint, n_hex bigint, "
              "base_sha256 string, spans string, n_random bigint")
    return narrow.mapInArrow(run, schema).withColumnRenamed("id", id_col)
