"""Finding secrets in texts: three patterns, and a token-efficiency test for random strings.

Patterns (fixed by contract): `assign` (a named password, secret, token or API key with a value of 8 or more
characters), `access` (AKIA and capitals or digits, 16 or more in all) and `hex` (32 or more lower-case
hexadecimal digits).

Token efficiency: a run of key characters is split by a tiktoken vocabulary; prose and names need few tokens
for their characters, random strings many. A run of at least MIN_RUN characters whose characters per token fall
below MAX_RATIO is reported as kind `token`. Where a run is not, its parts between `/` and `=` are tried as runs of their
own, so that a key in a path or after a name is found. Excluded first: runs that overlap a pattern's span, digests
(hexadecimal of the usual lengths), UUIDs, numbers, rows of one or two characters, and identifiers made of words joined by
`_` or `-`, by slashes or by capitals.

Defined results: a null or empty text has no spans; spans are in code points, ends exclusive; rows are kept
one for one.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ASSIGN = re.compile(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
HEX_LONG = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex")

MIN_RUN, MAX_RATIO = 16, 2.0
RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_RUN)
PART = re.compile(r"[A-Za-z0-9+_-]{%d,}" % MIN_RUN)
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
DIGEST = re.compile(r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128})")
NAME = re.compile(r"[A-Za-z]{2,}[0-9]{0,4}(?:[_/-]+(?:[A-Za-z]{2,}[0-9]{0,4}|[0-9]{1,4}))*=*")
#: Split points of camelCase names: a name of this kind has words of three letters or more on average.
CAMEL = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's index, end) of the three patterns, leftmost non-overlapping for each kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX_LONG.finditer(text)]
    return sorted(out)


def excluded(run: str) -> bool:
    """A known digest, a number or an identifier of several words."""
    if DIGEST.fullmatch(run) or UUID.fullmatch(run) or run.isdigit() or len(set(run)) < 3:
        return True
    if not NAME.fullmatch(run):
        return not any(c.isalpha() for c in run)
    words = [w for w in CAMEL.findall(run) if not w.isdigit()]
    if len(words) == 1:  # one word or random letters, which the ratio tells apart
        return False
    return not words or sum(map(len, words)) / len(words) >= 3


class Scanner:
    """Spans of a text, under a tiktoken vocabulary read from `vocabulary`."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import tiktoken

        self.encoding = tiktoken.Encoding("scan", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def _random(self, run: str) -> bool:
        return not excluded(run) and len(run) / len(self.encoding.encode_ordinary(run)) < MAX_RATIO

    def token_spans(self, text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
        out = []
        for m in RUN.finditer(text):
            near = [(s, e) for s, _, e in taken if s < m.end() and m.start() < e]
            if not near and self._random(m[0]):
                out.append(m.span())
                continue
            for x in PART.finditer(text, *m.span()):
                if x.span() != m.span() and not any(s < x.end() and x.start() < e for s, e in near) and self._random(x[0]):
                    out.append(x.span())
        return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    names = (*KINDS, "token")
    return ",".join(f"{names[k]}:{s}:{e}" for s, k, e in spans)


def load_vocabulary(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "/opt/tokenizers/byte_bpe_50k.tiktoken", pattern: str = r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+|\s+") -> DataFrame:
    """Rows (id_col, n_assign, n_access, n_hex, n_token, base_sha256, spans), one for each input row.

    The vocabulary (about a megabyte) is read where the plan is made and broadcast.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    ranks = docs.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(ranks.value, pattern)
        for b in batches:
            n = [[], [], [], []]
            digests, spans = [], []
            for t in b.column(1).to_pylist():
                base = base_spans(t) if t else []
                more = [(s, 3, e) for s, e in scanner.token_spans(t, base)] if t else []
                for k in range(3):
                    n[k].append(sum(x[1] == k for x in base))
                n[3].append(len(more))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(sorted(base + more)))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in n), pa.array(digests), pa.array(spans)], names=["id", "n_assign", "n_access", "n_hex", "n_token", "base_sha256", "spans"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(scan, f"id {kind}, n_assign long, n_access long, n_hex long, n_token long, base_sha256 string, spans string").withColumnRenamed("id", id_col)
