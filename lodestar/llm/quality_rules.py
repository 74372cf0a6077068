"""Quality rules: how far a document's characters and common words stray from any language.

Two histograms are taken of each text: byte classes (letters by case, digits, punctuation, lead
bytes of other scripts ...) and the common words of all languages with all other words in one bin. Common words are learned: for each language
the ``top_words`` words of letters that most of its documents hold, counted over all of them. References are the means of
the histograms of all documents of a language that are long enough. A document is kept if,
for at least one language, both Jensen-Shannon distances and their sum stay within their limits. Histograms of
few items are noisy, so neither test applies below a least length.

Null text counts as empty; empty and very short texts fail the base rules (n_words < 50). Rows
are judged one by one, so repeated rows get equal verdicts; an empty table gives no rows. Null
``lang`` gives no reference. A document of a named language that has no reference, or with letters of scripts that none of the
references holds, can't be judged by them: both tests are left out, and the base rules alone decide. Only doc_id, text and lang are read.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.llm.common import documents, map_batches

SPACE = b" \t\n\r\x0b\x0c"
SPACES = [b" ", b"\t", b"\n", b"\r", b"\x0b", b"\x0c"]
SYMBOLS = [b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">"]

#: ASCII characters that aren't letters.
NO_LETTER = re.compile(rb"[\x00-@\[-`{-\x7f]")
MARKS = b".,!;:"
#: (language, word) counts that a task holds before it emits them.
HELD = 400_000


@dataclass(frozen=True)
class QualityRules:
    """Limits of the rules. min_words guards the word test, min_chars the character test; max_foreign: share of
    lead bytes of scripts outside the references from which a text isn't judged."""

    min_base_words: int = 50
    max_repeat_percent: int = 50
    min_words: int = 50
    min_chars: int = 200
    max_char_distance: float = 0.24
    max_word_distance: float = 0.40
    max_sum: float = 0.50
    min_reference_docs: int = 20
    max_foreign: float = 0.1
    top_words: int = 32


def _byte_classes() -> tuple[np.ndarray, int]:
    """Class of each byte value; continuation bytes share a class that is dropped."""
    names = {}
    table = np.zeros(256, dtype=np.int64)
    for b in range(256):
        ch = chr(b)
        if 0x80 <= b < 0xC0:
            name = "continuation"
        elif b >= 0xF0:
            name = "lead4"
        elif b >= 0xE0:
            name = f"lead3-{b:x}"
        elif b >= 0xC0:
            name = f"lead2-{(b - 0xC0) // 4}"
        elif b in SPACE:
            name = "newline" if ch in "\n\r" else "space"
        elif ch.isupper():
            name = "upper"
        elif ch in "aeiou":
            name = "vowel"
        elif ch.islower():
            name = "consonant"
        elif ch.isdigit():
            name = "digit"
        elif ch in ".,;:'\"-()?":
            name = "punctuation"
        elif ch == "!":
            name = "exclamation"
        else:
            name = "symbol" if b > 32 else "control"
        table[b] = names.setdefault(name, len(names))
    return table, names["continuation"]


BYTE_CLASS, DROPPED = _byte_classes()
N_CLASSES = int(BYTE_CLASS.max()) + 1
#: Lead bytes of two and three bytes tell scripts apart; those of four are mostly pictures.
SCRIPTS = np.unique(BYTE_CLASS[0xC0:0xF0])


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Square root of the Jensen-Shannon divergence in bits, by row of p against the one distribution q:
    0 for equal distributions, 1 for disjoint ones."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        from_p = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=-1)
        from_q = np.where(q > 0, q * np.log2(q / m), 0).sum(axis=-1)
    return np.sqrt(np.maximum(0, (from_p + from_q) / 2))


def repeated_words(ids: np.ndarray, n_distinct: int) -> int:
    """Words that lie in a three-word window which occurs twice or more."""
    n = len(ids)
    if n < 4 or n == n_distinct:
        return 0
    if n_distinct < 1 << 20:
        keys = (ids[:-2] << 40) | (ids[1:-1] << 20) | ids[2:]
    else:
        pair = np.unique(ids[:-1] * n_distinct + ids[1:], return_inverse=True)[1]
        keys = pair[:-1] * n_distinct + ids[2:]
    order = np.argsort(keys)
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n - 2, dtype=bool)
    twice[1:] = same
    twice[:-1] |= same
    hit = np.zeros(n - 2, dtype=bool)
    hit[order] = twice
    covered = np.zeros(n, dtype=bool)
    for k in range(3):
        covered[k : n - 2 + k] |= hit
    return int(covered.sum())


class Words:
    """The words of a text, as ids by first place."""

    def __init__(self, text: bytes):
        found = text.split()
        seen: dict[bytes, int] = {}
        self.n = len(found)
        self.ids = np.fromiter([seen.setdefault(w, len(seen)) for w in found], dtype=np.int64, count=self.n)
        self.distinct = seen


def base_counts(text: bytes, words: Words) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    data = np.frombuffer(text, dtype=np.uint8)
    spaces = sum(map(text.count, SPACES))
    chars = len(data) - int(np.count_nonzero((data & 0xC0) == 0x80)) - spaces
    lines = [x for x in text.split(b"\n") if x.strip(SPACE)]
    return words.n, chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words.ids, len(words.distinct))


def histograms(text: bytes, words: Words, index: dict[bytes, int]) -> np.ndarray:
    """Counts of byte classes, then of common words with all other words last."""
    classes = np.bincount(BYTE_CLASS[np.frombuffer(text, dtype=np.uint8)], minlength=N_CLASSES)
    classes[DROPPED] = 0
    other = len(index)
    kinds = np.fromiter([index.get(w.strip(MARKS).lower(), other) for w in words.distinct], dtype=np.int64, count=len(words.distinct))
    return np.concatenate([classes, np.bincount(kinds[words.ids], minlength=other + 1)])


def scaled(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both histograms of each row, scaled to 1 (an empty one stays 0)."""
    char, word = counts[..., :N_CLASSES], counts[..., N_CLASSES:]
    return tuple(x / np.maximum(1e-300, x.sum(axis=-1, keepdims=True)) for x in (char, word))


def common_words(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """(lang, word): the words that most documents of a language hold, of its documents of min_base_words or more."""

    def work(chunks):
        seen: dict[bytes, Counter] = {}

        def settle():
            for lang, counted in seen.items():
                yield {"lang": [lang.decode()] * len(counted), "word": [w.decode() for w in counted], "n": list(counted.values())}
            seen.clear()

        for chunk in chunks:
            for text, lang in zip(chunk["text"], chunk["lang"]):
                if text is None or lang is None or (words := Words(text)).n < rules.min_base_words:
                    continue
                seen.setdefault(lang, Counter()).update({w for x in words.distinct if (w := x.strip(MARKS).lower()) and not NO_LETTER.search(w)})
            if sum(map(len, seen.values())) > HELD:
                yield from settle()
        yield from settle()

    counted = map_batches(docs, ["text", "lang"], "lang string, word string, n long", work).groupBy("lang", "word").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    return counted.withColumn("place", place).where(F.col("place") <= rules.top_words).select("lang", "word")


def references(docs: DataFrame, index: dict[bytes, int], rules: QualityRules = QualityRules()) -> DataFrame:
    """Per language and bin the sum of the histograms, each scaled to 1, of its documents of
    min_base_words or more; the bin after the last counts the documents."""
    width = N_CLASSES + len(index) + 1

    def work(chunks):
        sums: dict[bytes, np.ndarray] = {}
        for chunk in chunks:
            for text, lang in zip(chunk["text"], chunk["lang"]):
                if text is None or lang is None or (words := Words(text)).n < rules.min_base_words:
                    continue
                at = sums.setdefault(lang, np.zeros(width + 1))
                at[:width] += np.concatenate(scaled(histograms(text, words, index)))
                at[width] += 1
        for lang, at in sums.items():
            yield {"lang": [lang.decode()] * (width + 1), "bin": np.arange(width + 1), "mass": at}

    parts = map_batches(docs, ["text", "lang"], "lang string, bin int, mass double", work)
    return parts.groupBy("lang", "bin").agg(F.sum("mass").alias("mass"))


def quality_rules(docs: DataFrame, rules: QualityRules = QualityRules(), carried: list[str] | None = None) -> DataFrame:
    """Per row of docs: doc_id (or the columns carried), the base counts, both distances to the nearest language (null
    where not applied), base_failed and kept. Carried columns of these names give way."""
    # Rows per language are a constant, whatever the number of documents: top_words here, bins there.
    index = {w.encode(): k for k, w in enumerate(sorted({r.word for r in common_words(docs, rules).collect()}))}
    width = N_CLASSES + len(index) + 1
    sums: dict[str, np.ndarray] = {}
    for lang, bin_, mass in references(docs, index, rules).collect():
        sums.setdefault(lang, np.zeros(width + 1))[bin_] = mass
    refs = [(lang, *scaled(at[:width])) for lang, at in sorted(sums.items()) if at[width] >= rules.min_reference_docs]
    referred = {lang.encode() for lang, *_ in refs}
    # A script of which a reference has less than one byte in a thousand isn't covered by it.
    foreign = [c for c in SCRIPTS if not any(char_ref[c] >= 0.001 for _, char_ref, _ in refs)]

    results = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "base_failed": "boolean", "nearest_lang": "string", "char_distance": "double", "word_distance": "double", "kept": "boolean"}
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    columns = [c for c in carried or ["doc_id"] if c not in results]
    texts = [c for c in columns if kinds[c] == "string"]
    read = list(dict.fromkeys([*columns, "text", "lang"]))

    def work(chunks):
        for chunk in chunks:
            counts, hists = [], []
            for text in chunk["text"]:
                words = Words(text or b"")
                counts.append(base_counts(text or b"", words))
                hists.append(histograms(text or b"", words, index))
            n_words, chars, symbols, dup_lines, repeat = np.array(counts, dtype=np.int64).T
            failed = (n_words < rules.min_base_words) | (100 * repeat > rules.max_repeat_percent * n_words)
            char, word = scaled(np.array(hists))
            applies = np.array([lang is None or lang in referred for lang in chunk["lang"]]) & (char[:, foreign].sum(axis=1) <= rules.max_foreign)
            best = np.full(len(counts), np.inf)
            by_char, by_word = np.full((2, len(counts)), np.nan)
            nearest = np.full(len(counts), None, dtype=object)
            for lang, char_ref, word_ref in refs:
                dc = js_distance(char, char_ref)
                dw = np.where(n_words >= rules.min_words, js_distance(word, word_ref), np.nan)
                # A text far off in both at once is worse than one far off in either.
                excess = np.fmax(np.fmax(dc / rules.max_char_distance, dw / rules.max_word_distance), (dc + dw) / rules.max_sum)
                nearer = (excess < best) & (chars >= rules.min_chars) & ~failed & applies
                best[nearer], by_char[nearer], by_word[nearer], nearest[nearer] = excess[nearer], dc[nearer], dw[nearer], lang
            kept = ~failed & ((best <= 1) | np.isinf(best))
            yield {c: _as_text(chunk[c]) if c in texts else chunk[c] for c in columns} | {
                "n_words": n_words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup_lines, "n_repeat_words": repeat,
                "base_failed": failed, "nearest_lang": nearest, "char_distance": pa.array(by_char, from_pandas=True), "word_distance": pa.array(by_word, from_pandas=True), "kept": kept,
            }

    return map_batches(docs, read, ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), *(f"{c} {kind}" for c, kind in results.items())]), work)


def _as_text(values: list) -> list:
    return [None if v is None else v.decode() for v in values]


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with production limits."""
    df = quality_rules(documents(spark, sf_dir))
    return df.withColumns({c: F.round(c, 6) for c in ("char_distance", "word_distance")})


QUERIES = {"op1_quality_rules": op1_quality_rules}
_R = QualityRules()
_WORD = r"[^\x20\x09-\x0D]+"
ORACLE_SQL = {
    "op1_quality_rules": rf"""WITH texts AS (SELECT doc_id, lang, coalesce(text, '') AS text FROM documents),
words AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_WORD}')) AS word, generate_subscripts(regexp_extract_all(text, '{_WORD}'), 1) AS pos FROM texts),
windows AS (
  SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, word, second, third) AS n
  FROM (SELECT doc_id, pos, word, lead(word) OVER w AS second, lead(word, 2) OVER w AS third FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) WHERE third IS NOT NULL),
repeats AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest([pos, pos + 1, pos + 2]) AS place FROM windows WHERE n > 1) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM texts) WHERE regexp_matches(line, '{_WORD}') GROUP BY doc_id),
sizes AS (SELECT doc_id, count(*) AS n, sum(length(word))::BIGINT AS chars FROM words GROUP BY doc_id),
base AS (
  SELECT t.doc_id, t.lang, coalesce(s.n, 0) AS n_words, coalesce(s.chars, 0) AS word_chars, length(regexp_replace(t.text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(l.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, coalesce(s.n, 0) < {_R.min_base_words} OR 100 * coalesce(r.n, 0) > {_R.max_repeat_percent} * coalesce(s.n, 0) AS base_failed
  FROM texts t LEFT JOIN sizes s USING (doc_id) LEFT JOIN lines l USING (doc_id) LEFT JOIN repeats r USING (doc_id)),
folded AS (SELECT doc_id, translate(trim(word, '.,!;:'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS word FROM words),
taught AS (SELECT doc_id, lang FROM base WHERE lang IS NOT NULL AND n_words >= {_R.min_base_words}),
common AS (
  SELECT DISTINCT word FROM (
    SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY count(DISTINCT doc_id) DESC, word) AS place
    FROM folded JOIN taught USING (doc_id) WHERE word <> '' AND NOT regexp_matches(word, '[\x00-@\[-`{{-\x7f]') GROUP BY lang, word) WHERE place <= {_R.top_words}),
bins AS (
  SELECT doc_id, 'c' AS kind, {BYTE_CLASS.tolist()}[('0x' || code)::INTEGER + 1]::VARCHAR AS bin, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(hex(text), '..')) AS code FROM texts) GROUP BY ALL HAVING bin <> '{DROPPED}'
  UNION ALL SELECT f.doc_id, 'w', coalesce(c.word, ''), count(*) FROM folded f LEFT JOIN common c ON c.word = f.word GROUP BY ALL),
shares AS (SELECT doc_id, kind, bin, n / sum(n) OVER (PARTITION BY doc_id, kind) AS p FROM bins),
langs AS (SELECT lang, count(*) AS n FROM taught GROUP BY lang HAVING count(*) >= {_R.min_reference_docs}),
refs AS (SELECT lang, kind, bin, sum(p) / any_value(langs.n) AS q FROM shares JOIN taught USING (doc_id) JOIN langs USING (lang) GROUP BY lang, kind, bin),
alien AS (SELECT unnest({SCRIPTS.tolist()})::VARCHAR AS bin EXCEPT SELECT bin FROM refs WHERE kind = 'c' AND q >= 0.001),
odd AS (SELECT doc_id, sum(p) AS p FROM shares JOIN alien USING (bin) WHERE kind = 'c' GROUP BY doc_id),
judged AS (
  SELECT b.doc_id FROM base b LEFT JOIN odd o USING (doc_id)
  WHERE NOT b.base_failed AND b.word_chars >= {_R.min_chars} AND (b.lang IS NULL OR b.lang IN (SELECT lang FROM langs)) AND coalesce(o.p, 0) <= {_R.max_foreign}),
every AS (
  SELECT j.doc_id, r.lang, r.kind, r.bin, 0.0 AS p, r.q FROM judged j CROSS JOIN refs r
  UNION ALL SELECT s.doc_id, l.lang, s.kind, s.bin, s.p, 0.0 FROM shares s JOIN judged USING (doc_id) CROSS JOIN langs l),
met AS (SELECT doc_id, lang, kind, sum(p) AS p, sum(q) AS q FROM every GROUP BY doc_id, lang, kind, bin),
distances AS (
  SELECT doc_id, lang, kind, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2)) AS d
  FROM met GROUP BY ALL),
near AS (
  SELECT doc_id, lang, dc, dw, greatest(dc / {_R.max_char_distance}, dw / {_R.max_word_distance}, (dc + dw) / {_R.max_sum}) AS excess
  FROM (SELECT doc_id, lang, max(d) FILTER (WHERE kind = 'c') AS dc, max(d) FILTER (WHERE kind = 'w') AS dw FROM distances GROUP BY ALL)),
best AS (SELECT doc_id, min(excess) AS excess, arg_min(lang, (excess, lang)) AS lang, arg_min(dc, (excess, lang)) AS dc, arg_min(dw, (excess, lang)) AS dw FROM near GROUP BY doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n.lang AS nearest_lang, round(n.dc, 6) AS char_distance, round(n.dw, 6) AS word_distance,
  NOT base_failed AND coalesce(n.excess, 0) <= 1 AS kept
FROM base b LEFT JOIN best n USING (doc_id)""",
}
