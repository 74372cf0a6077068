"""Secret scan: fixed formats, and random strings exposed by their token efficiency.

Text that people write takes few tokens of a byte-pair vocabulary per character; random strings
fall apart into short pieces. A candidate is a run of ``[A-Za-z0-9+/_=-]`` of ``min_chars`` or more with
a letter; it is reported as ``random`` if it has fewer than ``max_chars_per_token`` characters per token
(``max_chars_per_token_letters`` without a digit, as rare long words come near the other). Only then is it looked at
whether the low efficiency comes from marks and numbers between words: an identifier (words joined by ``_``, ``-``, camel case,
dates and numbers) has letters that are efficient for themselves. Known digests (hexadecimal of a usual digest length,
UUIDs) and all that overlaps a span of a fixed format are left out.

Null text counts as empty (no spans). Rows are judged one by one, so repeated rows get equal results;
an empty table gives no rows. Only doc_id and text are read. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import base64
import hashlib
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from lodestar.llm.common import documents, map_batches, worker_cache

KINDS = ["assign", "access", "hex", "random"]
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a maximal run, as [0-9a-f]+ would take it
DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64})\Z|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\Z")
#: Parts are a capital or not and small letters, capitals, or digits.
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
#: Short parts of one case, joined by marks.
JOINED = re.compile(r"[A-Z0-9]{1,12}(?:[_-][A-Z0-9]{1,12})+\Z|[a-z0-9]{1,12}(?:[_-][a-z0-9]{1,12})+\Z")


@dataclass(frozen=True)
class SecretScan:
    """min_chars: shortest candidate; max_chars_per_token: efficiency below which it is random; max_chars_per_token_letters: the
    same for a run without a digit."""

    min_chars: int = 16
    max_chars_per_token: float = 2.2
    max_chars_per_token_letters: float = 1.95
    vocabulary: str | None = None


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def load_encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("secrets", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def is_identifier(run: str, least: float, encode) -> bool:
    """Whether run reads as words and numbers: letter parts of three or more on average, each taken for itself of ``least``
    characters per token together, and few changes between letters and digits; or short parts of one case joined by marks, at most
    half of them with both letters and digits (abbreviations, which take many tokens)."""
    if JOINED.match(run):
        joined_parts = re.split("[_-]", run)
        return 2 * sum(not p.isalpha() and not p.isdigit() for p in joined_parts) <= len(joined_parts)
    parts = PART.findall(run)
    letters = [p for p in parts if p[0].isalpha()]
    n_letters = sum(map(len, letters))
    if n_letters < 3 * len(letters) or len(parts) - len(letters) > max(2, len(letters)):
        return False
    return n_letters >= least * sum(len(encode(p)) for p in letters)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed formats, leftmost and non-overlapping by kind."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def joined(spans) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def random_spans(text: str, taken: list[tuple[int, int, int]], rules: SecretScan, encode) -> list[tuple[int, int, int]]:
    """Candidates of low token efficiency that overlap no taken span."""
    found = []
    for m in re.finditer(rf"[A-Za-z0-9+/_=-]{{{rules.min_chars},}}", text):
        run = m[0].strip("=-_/+")
        if len(run) < rules.min_chars or not any(c.isalpha() for c in run):
            continue
        least = rules.max_chars_per_token if any(c.isdigit() for c in run) else rules.max_chars_per_token_letters
        if len(run) >= least * len(encode(run)):
            continue
        start = m.start() + m[0].index(run)
        end = start + len(run)
        if DIGEST.match(run) or is_identifier(run, least, encode) or any(s < end and start < e for s, _, e in taken):
            continue
        found.append((start, 3, end))
    return found


def secret_scan(docs: DataFrame, rules: SecretScan = SecretScan()) -> DataFrame:
    """Per row of docs: doc_id, the counts by kind, base_sha256 and spans (all spans as text)."""
    path = rules.vocabulary or default_vocabulary()

    def work(chunks):
        cache = worker_cache()
        if cache.get("secrets", (None,))[0] != path:
            cache["secrets"] = (path, load_encoding(path))
        encode = cache["secrets"][1].encode_ordinary
        for chunk in chunks:
            rows = []
            for text in chunk["text"]:
                text = (text or b"").decode()
                base = base_spans(text)
                more = random_spans(text, base, rules, encode)
                counts = [sum(k == kind for _, k, _ in base) for kind in range(3)]
                rows.append((*counts, len(more), hashlib.sha256(joined(base).encode()).hexdigest(), joined(sorted(base + more))))
            yield {"doc_id": chunk["doc_id"]} | dict(zip(["n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"], map(list, zip(*rows))))

    return map_batches(docs, ["doc_id", "text"], "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string", work)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with production limits."""
    return secret_scan(documents(spark, sf_dir))


QUERIES = {"op3_secret_scan": op3_secret_scan}
