"""Language identification by unigram pieces with all segmentations summed.

The vocabulary is a fixed public one. Each language has a probability for each piece, from the pieces of
its training texts, smoothed over the whole vocabulary; a unit of text (a word with its leading mark) has
the sum, over all ways to cut it into pieces, of the products of their probabilities, by a forward pass over
its lattice. A unit is cut before that where no piece reaches across, as words and the marks behind them, so that few lattices
are new to a task. A text's log-likelihood is the sum over its units; with the languages' shares in training as
priors, lang_pred is the likeliest language and score its posterior probability.

Null text, and text without a letter, gives ``und`` with score 0. Rows with null lang are not learned from. Repeated
rows are judged alike; ties go to the language first in order. With nothing to learn from every row is ``und``. An
empty table gives no rows. Only doc_id, text and lang are read; a prediction reads the text alone.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from dataclasses import dataclass
from itertools import count

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import documents, map_batches, worker_cache
from lodestar.llm.lattice import MARK, UNIT, UNKNOWN, Arcs, Vocabulary, default_model

#: Parts of units that are put into one lattice at a time.
PARTS_AT_A_TIME = 20_000
#: Logarithms by part and language that a task remembers.
HELD_LOGS = 1 << 21
#: (language, unit) counts that a task holds before it turns them into counts of pieces.
HELD_UNITS = 200_000
#: Places of a forward pass between two scalings.
RESCALE = 8


@dataclass(frozen=True)
class LanguageId:
    """folds: documents whose crc32 of doc_id is 0 modulo folds are held out; smoothing: added to each count."""

    folds: int = 5
    smoothing: float = 0.5
    model: str | None = None


def held_out(doc_id: Column, folds: int, rest: int = 0) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds == rest


def vocabulary(path: str) -> Vocabulary:
    cache = worker_cache()
    if cache.get("pieces", (None,))[0] != path:
        cache["pieces"] = (path, Vocabulary(path))
    return cache["pieces"][1]


def units(text: str, words: Vocabulary) -> list[str]:
    """Units of the lower-cased text; white space alone is left out, as it tells nothing of the language."""
    low = text.lower()
    if MARK not in low:
        return [MARK + w for w in low.split()]
    return UNIT.findall(words.normalised(" ".join(low.split())))


def piece_counts(docs: DataFrame, rules: LanguageId) -> DataFrame:
    """(lang, piece, n): the model's own segmentation of the training texts; piece -1 counts documents."""
    path = rules.model or default_model()

    def work(chunks):
        words = vocabulary(path)
        totals: dict[bytes, np.ndarray] = {}
        held: dict[bytes, Counter] = {}

        def settle():
            for lang, counted in held.items():
                at = totals.setdefault(lang, np.zeros(words.size + 1, dtype=np.int64))
                strings = list(counted)
                # The mark in front is the model's own.
                got = words.model.encode([s[1:] if s[0] == "▁" else s for s in strings], num_threads=1)
                flat = np.concatenate([np.array(x, dtype=np.int64) for x in got]) if got else np.zeros(0, dtype=np.int64)
                np.add.at(at, flat, np.repeat([counted[s] for s in strings], [len(x) for x in got]))
            held.clear()

        for chunk in chunks:
            for text, lang in zip(chunk["text"], chunk["lang"]):
                if text is None or lang is None:
                    continue
                held.setdefault(lang, Counter()).update(units(text.decode(), words))
                totals.setdefault(lang, np.zeros(words.size + 1, dtype=np.int64))[words.size] += 1
            if sum(map(len, held.values())) > HELD_UNITS:
                settle()
        settle()
        for lang, at in totals.items():
            some = np.flatnonzero(at)
            yield {"lang": [lang.decode()] * len(some), "piece": np.where(some == words.size, -1, some).astype(np.int32), "n": at[some]}

    train = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"), rules.folds))
    return map_batches(train, ["text", "lang"], "lang string, piece int, n long", work).groupBy("lang", "piece").agg(F.sum("n").alias("n"))


def forward(arcs: Arcs, probability: np.ndarray, unknown: np.ndarray, longest: int) -> np.ndarray:
    """Log-probability of each string of arcs by language: all segmentations summed, whatever the string's length.

    probability: piece by language; unknown: what a character outside the vocabulary has, by language; longest: characters of
    the longest piece. Every RESCALE places the sums that later arcs may start from are scaled to 1 at most, as the
    sums of long strings would fall below the least double; the scales are kept as logarithms.
    """
    alpha = np.zeros((arcs.nodes, probability.shape[1]))
    alpha[arcs.first] = 1
    scales = np.zeros((len(arcs.first), probability.shape[1]))
    for place, some in enumerate(arcs.by_place(), 1):
        piece = arcs.piece[some]
        known = piece < UNKNOWN
        p = np.where(known[:, None], probability[np.where(known, piece, 0)], unknown)
        new = alpha[arcs.start[some]] * p
        end = arcs.end[some]
        order = np.argsort(end, kind="stable")
        at = np.flatnonzero(np.diff(end[order], prepend=-1))
        alpha[end[order][at]] = np.add.reduceat(new[order], at)
        if place % RESCALE == 0:
            further = np.flatnonzero(arcs.length > place)
            window = arcs.first[further][:, None] + np.arange(max(0, place - longest + 1), place + 1)
            most = alpha[window].max(axis=1)
            most[most == 0] = 1
            alpha[window] /= most[:, None]
            scales[further] += np.log(most)
    with np.errstate(divide="ignore"):
        return np.log(alpha[arcs.first + arcs.length]) + scales


def language_id(docs: DataFrame, rules: LanguageId = LanguageId()) -> DataFrame:
    """Per row of docs: doc_id, held_out, lang_pred and score."""
    path = rules.model or default_model()
    counts: dict[str, dict[int, int]] = {}
    # Languages times the vocabulary at most, whatever the number of documents.
    for lang, piece, n in piece_counts(docs, rules).collect():
        counts.setdefault(lang, {})[piece] = n
    langs = sorted(counts)
    size = Vocabulary(path).size
    table = np.full((size, len(langs)), rules.smoothing)
    for k, lang in enumerate(langs):
        own = {i: n for i, n in counts[lang].items() if i >= 0}
        table[list(own), k] += list(own.values())
    table /= np.maximum(table.sum(axis=0), 1e-300)
    total = sum(counts[lang].get(-1, 0) for lang in langs)
    prior = np.log([max(counts[lang].get(-1, 0), 1) / max(total, 1) for lang in langs])
    shipped = docs.sparkSession.sparkContext.broadcast(table)

    def work(chunks):
        words = vocabulary(path)
        table = shipped.value
        unknown = table.min(axis=0) if len(langs) else None
        known: dict[str, int] = {}
        held = np.zeros((0, len(langs)))
        for chunk in chunks:
            texts = [(t or b"").decode() for t in chunk["text"]]
            index: dict[str, int] = defaultdict(count().__next__)
            own = [np.array([index[u] for u in units(t, words)], dtype=np.int64) for t in texts]
            logs = np.zeros((len(index), len(langs)))
            if langs and index:
                if held.size > HELD_LOGS:
                    known, held = {}, held[:0]
                parts, first = words.parts(list(index))
                new = list(dict.fromkeys(p for p in parts if p not in known))
                known.update(zip(new, range(len(known), len(known) + len(new))))
                lattices = (Arcs(new[lo : lo + PARTS_AT_A_TIME], words) for lo in range(0, len(new), PARTS_AT_A_TIME))
                held = np.concatenate([held, *(forward(arcs, table, unknown, words.longest) for arcs in lattices)])
                logs = np.add.reduceat(held[[known[p] for p in parts]], first)
            preds, scores = [], []
            for text, mine in zip(texts, own):
                if not langs or not any(map(str.isalpha, text)):
                    preds.append("und")
                    scores.append(0.0)
                    continue
                log = prior + logs[mine].sum(axis=0)
                best = int(np.argmax(log))
                preds.append(langs[best])
                scores.append(float(1 / np.exp(log - log[best]).sum()))
            yield {"doc_id": chunk["doc_id"], "held_out": chunk["held_out"], "lang_pred": preds, "score": scores}

    rows = docs.select("doc_id", "text", held_out(F.col("doc_id"), rules.folds).alias("held_out"))
    return map_batches(rows, ["doc_id", "text", "held_out"], "doc_id long, held_out boolean, lang_pred string, score double", work)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, learned from four folds of five."""
    return language_id(documents(spark, sf_dir))


QUERIES = {"op5_language_id": op5_language_id}
