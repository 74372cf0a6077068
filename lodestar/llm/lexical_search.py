"""Ranked lexical search with MaxScore over shards of documents.

Documents are read once: a pass counts each one's terms and keeps its postings for the terms that items ask for. The
corpus figures (documents with a term, terms in all, documents per term) follow from what it stored. Then each task
turns its documents into shards of inverted lists and ranks every item over them by MaxScore: with the lists in order of
their largest contribution, those that even together stay below the k-th best score so far are non-essential. Only
documents in an essential list are candidates, and the others are probed, largest bound first, only for candidates
that can still reach that score. Documents go by in growing windows, so the threshold is there early. A shard is bounded by
documents and by postings, and each task hands on k rows an item at most; a window per item ranks these.

Items are handled in blocks of ``block_terms`` distinct (item, term) pairs, each with its own pass over the documents, so what
is sent to the tasks is bounded (but for one item with more than that many terms, which is a block of its own).

A term is a longest run of characters other than ASCII ones that are no letter or digit, with A-Z lower-cased; null has none. A document
counts if it has a term. A term's weight is floor(1000 * ln((2N + 2) / (2df + 1))), a document's m is 10 + ((90 * n * N) div L),
and its score is the sum of weight * ((10^9 * tf) div (1000 * tf + 8m)) over the item's terms, once each. Equal scores go by ascending doc_id, null last, so ties are
never left to chance. Rows are documents of their own even where texts or ids repeat; items with equal item_id are one item with the terms of all. Items without terms, or whose terms
no document has, give no rows; neither does an empty table. Only doc_id, text and item_id are read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.llm.common import documents, map_batches, stored

#: Bytes as terms see them: A-Z lower-cased, ASCII other than letters and digits as space.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
#: Documents of a shard's first window; each further one has twice as many.
FIRST_WINDOW = 256


@dataclass(frozen=True)
class LexicalSearch:
    """k: documents returned an item; shard_docs, shard_postings: most of a shard; block_terms: (item, term) pairs handled in one pass."""

    k: int = 10
    shard_docs: int = 16_384
    shard_postings: int = 4_000_000
    block_terms: int = 500_000


def terms(text: bytes | None) -> list[bytes]:
    return text.translate(TERM_BYTES).split() if text else []


# ---------------------------------------------------------------- MaxScore


class Best:
    """The k best (score, doc_id) so far, equal scores by doc_id; a null doc_id comes last."""

    def __init__(self, k: int):
        self.k = k
        self.scores = self.ids = np.zeros(0, dtype=np.int64)
        self.null = np.zeros(0, dtype=bool)

    @property
    def least(self) -> int:
        """The score below which no document can get in."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        scores, ids, null = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids]), np.concatenate([self.null, null])
        first = np.lexsort((ids, null, -scores))[: self.k]
        self.scores, self.ids, self.null = scores[first], ids[first], null[first]


class Shard:
    """Inverted lists of some documents: for each term the documents (by place, ascending) and their contributions."""

    def __init__(self, ids: np.ndarray, null: np.ndarray, term: np.ndarray, doc: np.ndarray, score: np.ndarray):
        order = np.argsort(term, kind="stable")
        self.ids, self.null = ids, null
        self.doc, self.score = doc[order], score[order]
        self.terms, self.starts = np.unique(term[order], return_index=True)
        self.ends = np.append(self.starts[1:], len(order))
        self.bounds = np.maximum.reduceat(self.score, self.starts) if len(order) else np.zeros(0, dtype=np.int64)

    def rank(self, asked: np.ndarray, best: Best) -> None:
        """MaxScore: adds to best what documents of this shard reach for the terms asked for (ascending)."""
        at = np.flatnonzero(np.isin(self.terms, asked) & (self.bounds > 0))
        at = at[np.argsort(self.bounds[at], kind="stable")]
        if not len(at):
            return
        up_to = np.cumsum(self.bounds[at])  # what lists 0..i can add
        docs = [self.doc[self.starts[i] : self.ends[i]] for i in at]
        scores = [self.score[self.starts[i] : self.ends[i]] for i in at]
        lo, width = 0, FIRST_WINDOW
        while lo < len(self.ids):
            hi = min(len(self.ids), lo + width)
            essential = int(np.searchsorted(up_to, best.least))  # lists before it stay below the threshold together
            if essential == len(at):
                return
            sums = np.zeros(hi - lo, dtype=np.int64)
            for i in range(essential, len(at)):
                a, b = np.searchsorted(docs[i], (lo, hi))
                sums[docs[i][a:b] - lo] += scores[i][a:b]
            found = np.flatnonzero(sums)
            for i in range(essential - 1, -1, -1):
                found = found[sums[found] + up_to[i] >= best.least]
                if not len(found):
                    break
                place = np.searchsorted(docs[i], found + lo)
                place[place == len(docs[i])] = 0
                hit = docs[i][place] == found + lo
                sums[found[hit]] += scores[i][place[hit]]
            found = found[sums[found] >= best.least]
            if len(found):
                best.add(sums[found], self.ids[lo + found], self.null[lo + found])
            lo, width = hi, 2 * width


# ---------------------------------------------------------------- Spark


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Per row of docs: doc_id, n (its terms), and of the terms in vocabulary it holds the numbers and counts, ascending."""
    shipped = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def work(chunks):
        number = shipped.value.get
        size = max(1, len(shipped.value))
        for chunk in chunks:
            n, held = [], []
            for text in chunk["text"]:
                words = terms(text)
                n.append(len(words))
                held.append(np.array([x for x in map(number, words) if x is not None], dtype=np.int64))
            rows = np.repeat(np.arange(len(held)), [len(x) for x in held])
            keys, counts = np.unique(rows * size + np.concatenate(held), return_counts=True)
            offsets = pa.array(np.searchsorted(keys, np.arange(len(held) + 1) * size).astype(np.int32))
            lists = lambda values: pa.ListArray.from_arrays(offsets, pa.array(values.astype(np.int32)))
            yield {"doc_id": chunk["doc_id"], "n": n, "terms": lists(keys % size), "counts": lists(counts)}

    return map_batches(docs, ["doc_id", "text"], "doc_id long, n long, terms array<int>, counts array<int>", work)


def _shards(batches, weights: np.ndarray, total: int, length: int, rules: LexicalSearch):
    """Shards of what batches of postings hold."""
    parts, n_docs, n_postings = [], 0, 0

    def made():
        ids, null, counts, term, tf, n = (np.concatenate([p[i] for p in parts]) for i in range(6))
        doc = np.repeat(np.arange(len(ids)), counts)
        m = 10 + (90 * n * total) // max(1, length)
        return Shard(ids, null, term, doc, weights[term] * ((10**9 * tf) // (1000 * tf + 8 * m[doc])))

    for batch in batches:
        for lo in range(0, batch.num_rows, rules.shard_docs):
            some = batch.slice(lo, rules.shard_docs)
            ids, lists = some.column("doc_id"), some.column("terms")
            offsets = lists.offsets.to_numpy().astype(np.int64)
            counts = np.diff(offsets)
            term, tf = lists.flatten().to_numpy(), some.column("counts").flatten().to_numpy().astype(np.int64)
            parts.append((ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), counts, term, tf, some.column("n").to_numpy()))
            n_docs, n_postings = n_docs + len(ids), n_postings + len(term)
            if n_docs >= rules.shard_docs or n_postings >= rules.shard_postings:
                yield made()
                parts, n_docs, n_postings = [], 0, 0
    if parts:
        yield made()


def _ranked(docs: DataFrame, items: dict, rules: LexicalSearch) -> DataFrame:
    """item_id, rank, doc_id and score for one block of items: item_id to its terms."""
    spark = docs.sparkSession
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*items.values())))}
    held = stored(postings(docs, vocabulary), "postings")
    sums = held.agg(F.count_if(F.col("n") > 0).alias("total"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
    weights = np.zeros(len(vocabulary), dtype=np.int64)
    # One row a term that is asked for.
    for term, df in held.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        weights[term] = math.floor(1000 * math.log((2 * sums.total + 2) / (2 * df + 1)))
    ids = list(items)
    asked = [np.array(sorted(vocabulary[t] for t in items[i]), dtype=np.int64) for i in ids]
    shipped = spark.sparkContext.broadcast((weights, ids, asked))
    total, length = sums.total, sums.length

    def run(batches):
        weights, ids, asked = shipped.value
        best = [Best(rules.k) for _ in ids]
        for shard in _shards(batches, weights, total, length, rules):
            for mine, own in zip(asked, best):
                shard.rank(mine, own)
        scores = [own.scores for own in best]
        item = np.repeat(np.arange(len(ids)), [len(x) for x in scores])
        if len(item):
            doc_id = pa.array(np.concatenate([own.ids for own in best]), mask=np.concatenate([own.null for own in best]))
            yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in item], pa.int64()), doc_id, pa.array(np.concatenate(scores))], names=["item_id", "doc_id", "score"])

    found = held.where("size(terms) > 0").mapInArrow(run, "item_id long, doc_id long, score long")
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", place).where(F.col("rank") <= rules.k).select("item_id", "rank", "doc_id", "score")


def lexical_search(docs: DataFrame, items: DataFrame, rules: LexicalSearch = LexicalSearch()) -> DataFrame:
    """The k best documents of docs (doc_id, text) for each item (item_id, text): item_id, rank, doc_id and score."""

    def work(chunks):
        for chunk in chunks:
            yield {"item_id": chunk["item_id"], "terms": [sorted(set(terms(t))) for t in chunk["text"]]}

    asked = stored(map_batches(items, ["item_id", "text"], "item_id long, terms array<binary>", work).where("size(terms) > 0"), "items")
    pairs = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = max(1, -(-pairs // rules.block_terms))
    out = None
    for block in range(blocks):
        some: dict = {}
        for item_id, own in asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).toLocalIterator():
            some.setdefault(item_id, set()).update(map(bytes, own))
        if some or out is None:
            found = _ranked(docs, some, rules)
            out = found if out is None else out.unionByName(found)
    return out


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all documents for each benchmark item."""
    return lexical_search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op12_lexical_search": op12_lexical_search}
#: Every score of every document that holds a term.
ORACLE_SQL = {
    "op12_lexical_search": r"""WITH split AS (
  SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
corpus AS (SELECT count(*) FILTER (len(terms) > 0) AS total, sum(len(terms))::BIGINT AS length FROM split),
held AS (SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(terms) AS term FROM split) GROUP BY d, term),
weighed AS (SELECT term, floor(1000 * ln((2 * any_value(total) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM held, corpus WHERE term IN (SELECT term FROM asked) GROUP BY term),
sized AS (SELECT d, doc_id, 10 + ((90 * len(terms) * total) // length) AS m FROM split, corpus),
scored AS (
  SELECT a.item_id, s.d, any_value(s.doc_id) AS doc_id, sum(w.w * ((1000000000 * h.tf) // (1000 * h.tf + 8 * s.m)))::BIGINT AS score
  FROM asked a JOIN weighed w ON w.term = a.term JOIN held h ON h.term = a.term JOIN sized s ON s.d = h.d GROUP BY a.item_id, s.d),
placed AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 10""",
}
