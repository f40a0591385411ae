"""Secret scan: strings of which a token covers few characters are random.

Byte-pair vocabularies hold the common pieces of words and identifiers, so that such strings need
few tokens and random ones many. Candidates are runs of at least ``LEAST`` characters of the base64
and URL alphabets, ``LEAST_NAMED`` behind a credential's name, with a letter among them. Excluded are

- digests: hexadecimal runs of a digest's length, and base64 behind an algorithm's name, unless a
  credential's name introduces them; the digests of empty input in any case,
- identifiers: UUIDs without a credential's name, numbers, and names put together from words.

What is left with at most ``most_ratio`` characters per token is reported. Where a whole run isn't, and no
digest, its parts between ``/ = - _`` are judged alike, so that a path of words before a random string
doesn't hide it. Defined results: null and empty texts report nothing; very long texts and strings are
scanned whole; each occurrence is a row of its own, so that repeated strings and rows repeat, and
nothing can tie; rows with null doc_id are reported with it; of an empty table the result is empty;
extra columns are ignored, and passed through by ``redact``, which replaces the strings and keeps
n_chars, if there is such a column, up to date. The vocabulary's file has to be at the same path on
all executors.
Offsets count characters, from 0; the end is exclusive.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the vocabulary's texts are split before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LEAST = 20
#: Behind a credential's name.
LEAST_NAMED = 16
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{LEAST_NAMED},}}"
_CANDIDATE = re.compile(CANDIDATE)
_PART = re.compile(rf"[A-Za-z0-9+]{{{LEAST_NAMED},}}")
_NAMED = re.compile(r"(?i)(?:token|secret|passw(?:or)?d|passwd|pwd|credential|bearer|auth\w*|api[_ -]?key|access[_ -]?key|private[_ -]?key|key)[\"']?\s*(?:[:=]|=>|is)?\s*[\"']?$")
_DIGEST_NAMED = re.compile(r"(?i)(?:sha-?\d+|md5|commit|checksum|digest|integrity|etag|blake\w+)[\"']?\s*[:=\- ]\s*[\"']?$")
_HEX = re.compile(r"(?i)[0-9a-f]+")
_UUID = re.compile(r"(?i)[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}")
_PIECES = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_DIGEST_LENGTHS = {32, 40, 48, 56, 64, 96, 128}
_EMPTY = {"d41d8cd98f00b204e9800998ecf8427e", "da39a3ee5e6b4b0d3255bfef95601890afd80709", "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"}
_FOUND = pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("secret", pa.string()), ("n_tokens", pa.int32()), ("chars_per_token", pa.float64())])


@lru_cache(4)
def encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def digest(s: str, before: str) -> bool:
    """Whether a string is a known digest or a UUID, which no credential's name introduces."""
    if s.lower() in _EMPTY:
        return True
    if _NAMED.search(before):
        return False
    return bool(_DIGEST_NAMED.search(before) or _UUID.fullmatch(s) or len(s) in _DIGEST_LENGTHS and _HEX.fullmatch(s))


def excluded(s: str, before: str) -> bool:
    """Whether a string is a known digest or identifier, or without letters."""
    if not any(c.isalpha() for c in s) or digest(s, before):
        return True
    named = _NAMED.search(before) is not None
    # words of three letters or more, joined by case or separators, with few digits between
    pieces = _PIECES.findall(s)
    wordy = sum(len(p) for p in pieces if p.isalpha() and len(p) >= 3)
    # letters of one case are a single piece whatever they are: the tokens tell
    return not named and not (s.isalpha() and (s.islower() or s.isupper())) and wordy >= 0.8 * len(s.strip("=+/_-"))


def secrets_of(text: str, tokens: tiktoken.Encoding, most_ratio: float) -> list[tuple[int, int, str, int]]:
    """(start, end, string, tokens) of each secret in a text."""
    out = []

    def judge(s: str, start: int, before: str) -> bool:
        if len(s) < (LEAST_NAMED if _NAMED.search(before) else LEAST) or excluded(s, before):
            return False
        n = len(tokens.encode_ordinary(s))
        if len(s) <= most_ratio * n:
            out.append((start, start + len(s), s, n))
            return True
        return False

    for m in _CANDIDATE.finditer(text):
        s = m.group().lstrip("=").strip("-_/")  # rules, paths and assignments
        before = text[max(0, m.start() - 40) : m.start()]
        start = m.start() + m.group().index(s)
        if judge(s, start, before) or digest(s, before):
            continue
        for p in _PART.finditer(s):
            if len(p.group()) < len(s):
                at = start + p.start()
                judge(p.group(), at, text[max(0, at - 40) : at])
    return out


def scan(docs: DataFrame, *, vocabulary: str = VOCABULARY, most_ratio: float = 2.2) -> DataFrame:
    """doc_id, start, end, secret, n_tokens, chars_per_token of each random string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoding(vocabulary)
        for b in slices(batches, "text"):
            rows = [(d, *x, (x[1] - x[0]) / x[3]) for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True) for x in secrets_of(t, tokens, most_ratio)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _FOUND, strict=True)], schema=_FOUND)

    # texts without a candidate never leave the JVM
    some = docs.where(F.col("text").rlike(CANDIDATE)).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return some.mapInArrow(run, "doc_id long, start int, end int, secret string, n_tokens int, chars_per_token double")


def redact(docs: DataFrame, *, vocabulary: str = VOCABULARY, most_ratio: float = 2.2, mark: str = "[SECRET]") -> DataFrame:
    """The documents with their secrets replaced; all rows and columns stay."""
    counted = "n_chars" in docs.columns and "n_chars" != "text"

    def clean(text: str, tokens: tiktoken.Encoding) -> str:
        for start, end, _, _ in reversed(secrets_of(text, tokens, most_ratio)):
            text = text[:start] + mark + text[end:]
        return text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoding(vocabulary)
        for b in batches:
            names = b.schema.names
            texts = b.column(names.index("text"))
            hit = [i for i, x in enumerate(pc.match_substring_regex(texts, CANDIDATE).to_pylist()) if x]
            new = {i: y for i in hit if (y := clean(x := texts[i].as_py(), tokens)) != x}
            if new:
                mask = pa.array([i in new for i in range(b.num_rows)])
                b = b.set_column(names.index("text"), b.schema.field("text"), pc.replace_with_mask(texts, mask, pa.array(list(new.values()), texts.type)))
                if counted:
                    k = names.index("n_chars")
                    sizes = pa.array([len(t) for t in new.values()]).cast(b.column(k).type)
                    b = b.set_column(k, b.schema.field("n_chars"), pc.replace_with_mask(b.column(k), mask, sizes))
            yield b

    return docs.mapInArrow(run, docs.schema)
