"""Secret scans: three base patterns, and random strings found by token efficiency.

A byte-pair vocabulary packs language into few tokens and random strings into
many. A long unbroken string with few characters per token is therefore a
likely secret, unless its shape is that of a known digest or identifier. So is
every long stretch of tokens inside one that has words besides, as in a path.
Runs of a byte class are found over whole Arrow batches at once; only the few
strings that come into question meet the tokenizer.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phonoframe.llm.common import kept, slices, table, utf8

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
ASSIGN_FROM, ACCESS_FROM, HEX_FROM = 12, 18, 16
#: A run of RANDOM_CHARS, or a stretch of its tokens, from this length on with at most this many characters per token is random.
RANDOM_FROM, CHARS_PER_TOKEN = 20, 2.0
#: The measure counts the tokens of a run in pieces of so many characters, as the tokenizer needs more than linear time for one; a piece's end adds a token at most.
PIECE = 512
#: Shapes of digests (MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512) and of identifiers (UUID, plain numbers and dates).
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
DIGEST = re.compile(rb"(?:[0-9a-f]+|[0-9A-F]+)")
IDENTIFIER = re.compile(rb"(?i:[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12})|[0-9+/_=-]+")
#: Letters joined by marks: words or not, as the ratio of the letters says, whatever the marks.
JOINED, JOIN = re.compile(rb"[A-Za-z]+(?:[-_/=+][A-Za-z]+)+[-_/=+]?[0-9]{0,6}"), re.compile(rb"(?<=[A-Za-z])[-_/=+](?=[A-Za-z])")
WORDS = re.compile(rb"(?<![A-Za-z0-9])[A-Za-z]+(?:[-_/=+][A-Za-z]+)+(?![A-Za-z0-9])")
#: What may be one of those shapes between others of a run: UUIDs, parts of hexadecimal digits, rows of marks.
INNER = re.compile(rb"(?<![A-Za-z0-9])(?:(?i:[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12})|[0-9a-f]+|[0-9A-F]+)(?![A-Za-z0-9])|[+/_=-]{3,}")
_SLICE = 8 << 20


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_DIGITS, _LOWER, _UPPER = b"0123456789", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
HEX_CHARS, RANDOM_CHARS = _class(_DIGITS + b"abcdef"), _class(_DIGITS + _LOWER + _UPPER + b"+/_=-")


def runs(raw: np.ndarray, at: np.ndarray, members: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, start and end (in the buffer) of the longest runs of member bytes, of `least` bytes or more, within documents."""
    is_in = members[raw]
    edge = np.empty(len(raw) + 1, bool)
    edge[0] = edge[-1] = True
    edge[1:-1] = is_in[1:] != is_in[:-1]
    edge[at] = True
    cuts = np.flatnonzero(edge)
    start, end = cuts[:-1], cuts[1:]
    keep = (end - start >= least) & is_in[start] if len(start) else np.zeros(0, bool)
    start, end = start[keep], end[keep]
    return np.searchsorted(at, start, "right") - 1, start, end


def vocabulary(path: str):
    """A tiktoken encoding from a file of ranks, without special tokens."""
    return kept(f"vocabulary {path}", lambda: _vocabulary(path))


def _vocabulary(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def known(string: bytes) -> bool:
    """Whether a string has the shape of a digest or an identifier."""
    return bool(len(string) in DIGEST_LENGTHS and DIGEST.fullmatch(string) or IDENTIFIER.fullmatch(string))


def is_random(string: bytes, path: str, most: float = CHARS_PER_TOKEN) -> bool:
    """Whether a run of RANDOM_CHARS has few characters per token and isn't a digest or an identifier."""
    if known(string):
        return False
    parts = JOIN.split(string) if JOINED.fullmatch(string) else [string]
    tokens = sum(len(vocabulary(path).encode_ordinary(part[i : i + PIECE].decode())) for part in parts for i in range(0, len(part), PIECE))
    return sum(map(len, parts)) <= most * tokens


def _pieces(string: bytes) -> Iterator[tuple[int, int, bool]]:
    """Start, end and whether the token test counts it, of the known shapes in a run and what is between them."""
    at = 0
    for m in INNER.finditer(string):
        part = m[0]
        if not part.isalnum() or part.isdigit() or len(part) in DIGEST_LENGTHS:
            if m.start() > at:
                yield at, m.start(), True
            yield m.start(), m.end(), False
            at = m.end()
    if at < len(string):
        yield at, len(string), True


def random_stretches(string: bytes, path: str, most: float = CHARS_PER_TOKEN) -> list[tuple[int, int]]:
    """Start and end of what is random in a run: all of it, or every longest stretch of its tokens that passes the test without its known shapes; overlapping ones are one."""
    if known(string):
        return []
    if is_random(string, path, most):
        return [(0, len(string))]
    size: list[int] = []
    counted: list[bool] = []
    for a, b, counts in _pieces(string):
        if not counts:
            size, counted = [*size, b - a], [*counted, False]
            continue
        for i in range(a, b, PIECE):
            tokens = vocabulary(path).encode_ordinary(string[i : min(i + PIECE, b)].decode())
            new = [len(x) for x in vocabulary(path).decode_tokens_bytes(tokens)]
            size += new
            counted += [True] * len(new)
    n, is_in = np.array(size, np.int64), np.array(counted, bool)
    place = np.concatenate([[0], np.cumsum(n)])
    judged = is_in.copy()
    joins = np.array([m.start() for w in WORDS.finditer(string) for m in JOIN.finditer(string, *w.span())], np.int64)
    judged[np.isin(place[:-1], joins) & (n == 1)] = False
    chars, above = (np.concatenate([[0], np.cumsum(x)]) for x in (n * is_in, (n - most) * judged))
    # From each token, the last place up to which there are at most `most` characters per token.
    far = np.searchsorted(np.minimum.accumulate(above[::-1])[::-1], above, "right") - 1
    last = np.maximum.accumulate(np.where(np.concatenate([[True], is_in]), np.arange(len(place)), 0))
    far = last[far]
    good = np.flatnonzero((chars[far] - chars >= RANDOM_FROM)[:-1] & is_in)
    out: list[tuple[int, int]] = []
    for s, e in zip(place[good].tolist(), place[far[good]].tolist(), strict=True):
        if out and s <= out[-1][1]:
            out[-1] = out[-1][0], max(e, out[-1][1])
        else:
            out.append((s, e))
    return [(s, e) for s, e in out if not known(string[s:e])]


def find(raw: np.ndarray, at: np.ndarray, path: str) -> dict[int, list[tuple[int, int, int]]]:
    """Document -> (start, kind, end) in bytes of the document, in this order."""
    found: dict[int, list[tuple[int, int, int]]] = {}
    for kind, members, least in ((2, HEX_CHARS, HEX_FROM), (3, RANDOM_CHARS, RANDOM_FROM)):
        for d, s, e in zip(*(x.tolist() for x in runs(raw, at, members, least)), strict=True):
            for a, b in [(0, e - s)] if kind == 2 else random_stretches(raw[s:e].tobytes(), path):
                found.setdefault(d, []).append((s + a - int(at[d]), kind, s + b - int(at[d])))
    view = memoryview(raw.tobytes())
    for d, (s, e) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        text = view[s:e]
        for m in ASSIGN.finditer(text):
            if m.end(1) - m.start(1) >= ASSIGN_FROM:
                found.setdefault(d, []).append((m.start(), 0, m.end()))
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= ACCESS_FROM:
                found.setdefault(d, []).append((m.start(), 1, m.end()))
    return {d: sorted(x) for d, x in found.items()}


def in_code_points(text: np.ndarray, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Byte spans of one document as spans of code points."""
    before = np.concatenate([[0], np.cumsum((text & 0xC0) != 0x80)])
    return [(int(before[s]), k, int(before[e])) for s, k, e in spans]


def scanned(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256 and spans of every document.

    spans lists kind:start:end by start, then kind in the order of KINDS; starts
    and ends count code points, ends are exclusive. Base spans are listed
    whatever the token test says. A null or empty text has no spans; repeated
    rows are scanned one by one; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            whole, offsets = utf8(batch.column(1))
            for i, j in slices(offsets, _SLICE):
                raw, at = whole[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                counts = np.zeros((4, j - i), np.int64)
                base, spans = [nothing] * (j - i), [""] * (j - i)
                for d, found in find(raw, at, vocabulary_path).items():
                    named = [(k, f"{KINDS[k]}:{s}:{e}") for s, k, e in in_code_points(raw[at[d] : at[d + 1]], found)]
                    for k, _ in named:
                        counts[k, d] += 1
                    base[d] = hashlib.sha256(",".join(x for k, x in named if k < 3).encode()).hexdigest()
                    spans[d] = ",".join(x for _, x in named)
                yield pa.record_batch(
                    [batch.column(0).slice(i, j - i), *map(pa.array, counts), pa.array(base), pa.array(spans)],
                    names=["doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string")


def redact(text: Column, vocabulary_path: str, mask: str = "[secret]") -> Column:
    """The text with every span (overlapping ones as one) replaced by the mask; null stays null."""

    @F.pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        raw, at = utf8(pa.array(texts, pa.large_string(), from_pandas=True))
        out = texts.copy()
        for i, j in slices(at, _SLICE):
            part, cuts = raw[at[i] : at[j]], at[i : j + 1] - at[i]
            for d, found in find(part, cuts, vocabulary_path).items():
                kept, upto = [], 0
                for s, _, e in found:
                    if s >= upto:
                        kept += [part[cuts[d] + upto : cuts[d] + s].tobytes(), mask.encode()]
                    upto = max(upto, e)
                kept.append(part[cuts[d] + upto : cuts[d + 1]].tobytes())
                out.iloc[i + d] = b"".join(kept).decode()
        return out

    return masked(text)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans of every document (the contract of ``scanned``)."""
    return scanned(table(spark, sf_dir, "documents"), default_vocabulary())
