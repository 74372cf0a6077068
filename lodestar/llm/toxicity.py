"""Toxicity by a factorization machine over hashed terms.

A document's terms are its distinct words, lower-cased, and their beginnings of 4, 5 and 6 characters (so inflected forms meet), each by its hash. The
logit of a text is a bias, a weight for each term, and for each two of its terms the product of their factor vectors: what two terms
say together, such as an insult with a group, has a weight of its own that no sum over single terms has.

Evidence for terms is counted over all labelled documents of the training folds: terms whose documents are toxic more often than
others', by ``least_lift`` and by ``least_z`` standard deviations, are terms of the model, the ``features`` strongest at most. Other terms carry none, so a text of any length without
such terms has the score of an empty one. The machine is fitted by stochastic gradient steps on a sample of ``sample_rows`` documents of each
label at most (in expectation; those of least hash, weighted by what they stand for), and scores every text. Where labels fit into ``broadcast_rows`` rows
they are sent to the documents, otherwise both meet by doc_id.

Null and empty text has no terms; its score is that of the bias. Labels that are null are left out; of several for a doc_id the highest counts. Without toxic or without
other labelled documents the score is the share of toxic ones (0 without labels). Repeated rows are scored alike. An empty table gives no rows. Of documents only doc_id and text are read, and a score reads the
text alone.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import Sums, documents, map_batches, summed
from lodestar.llm.language_id import held_out
from lodestar.llm.lexical_search import terms

#: Characters of the beginnings that count as terms.
BEGINNINGS = (4, 5, 6)
#: Bits of a term's hash.
HASH_BITS = 40
#: Terms' counts that a task holds before it sums them.
HELD = 1_000_000
#: Distinct words whose terms a task remembers.
KNOWN_WORDS = 300_000


@dataclass(frozen=True)
class Toxicity:
    """folds: documents whose crc32 of doc_id is 0 modulo folds are held out; factors: numbers of a term's vector; epochs, batch, weight_rate,
    vector_rate, weight_decay, vector_decay: of the gradient steps."""

    folds: int = 5
    least_docs: int = 5
    least_z: float = 4.0
    least_lift: float = 1.5
    features: int = 65_536
    sample_rows: int = 20_000
    broadcast_rows: int = 1_000_000
    factors: int = 8
    epochs: int = 20
    batch: int = 256
    weight_rate: float = 1.0
    vector_rate: float = 0.02
    weight_decay: float = 3e-5
    vector_decay: float = 3e-3
    seed: int = 1


# ---------------------------------------------------------------- terms


def word_terms(word: bytes) -> list[int]:
    """Hashes of a word and its beginnings."""
    import xxhash

    out = [xxhash.xxh3_64_intdigest(word) >> (64 - HASH_BITS)]
    if len(word) > BEGINNINGS[0]:
        text = word.decode()
        out += [xxhash.xxh3_64_intdigest(text[:k].encode(), k) >> (64 - HASH_BITS) for k in BEGINNINGS if len(text) > k]
    return out


def distinct_words(texts: list[bytes | None]) -> list[set[bytes]]:
    return [set(terms(t.decode().lower().encode())) if t else set() for t in texts]


class Terms:
    """Numbers of the terms of a model (ascending hashes) that words have."""

    def __init__(self, hashes: np.ndarray):
        self.number = {int(h): i for i, h in enumerate(hashes)}
        self.known: dict[bytes, tuple[int, ...]] = {}

    def of(self, words: set[bytes]) -> list[int]:
        """Distinct numbers, ascending."""
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        known, out = self.known, set()
        for w in words:
            found = known.get(w)
            if found is None:
                found = known[w] = tuple(self.number[h] for h in word_terms(w) if h in self.number)
            if found:
                out.update(found)
        return sorted(out)


def evidence(labelled: DataFrame) -> DataFrame:
    """(term, n, n_toxic): documents of labelled (text, toxic) that hold each term."""

    def work(chunks):
        sums = Sums(2)

        def out():
            term, n, n_toxic = sums.taken()
            return {"term": term, "n": n, "n_toxic": n_toxic}

        for chunk in chunks:
            held = distinct_words(chunk["text"])
            index: dict[bytes, int] = {}
            own = [np.array([index.setdefault(w, len(index)) for w in words], dtype=np.int64) for words in held]
            if not index:
                continue
            of_word = [word_terms(w) for w in index]
            hashes, number = np.unique(np.concatenate([np.array(x, dtype=np.int64) for x in of_word]), return_inverse=True)
            sizes = np.array([len(x) for x in of_word])
            starts = np.cumsum(sizes) - sizes
            # (document, term), once each.
            words, doc = np.concatenate(own), np.repeat(np.arange(len(own)), [len(x) for x in own])
            reps = sizes[words]
            at = np.repeat(starts[words] - np.cumsum(reps) + reps, reps) + np.arange(reps.sum())
            keys = np.unique(np.repeat(doc, reps) * len(hashes) + number[at])
            toxic = np.array(chunk["toxic"], dtype=np.int64)[keys // len(hashes)]
            sums.add(*summed(hashes[keys % len(hashes)], np.ones(len(keys), dtype=np.int64), toxic))
            if sums.held > HELD:
                sums.add(*sums.taken())
                if sums.held > HELD // 2:
                    yield out()
        yield out()

    return map_batches(labelled, ["text", "toxic"], "term long, n long, n_toxic long", work).groupBy("term").agg(F.sum("n").alias("n"), F.sum("n_toxic").alias("n_toxic"))


# ---------------------------------------------------------------- the machine


@dataclass
class Machine:
    """A bias, and for each term (by ascending hash) a weight and a vector."""

    terms: np.ndarray
    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def logits(self, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Of documents whose terms' numbers stand one after another in flat, sizes each."""
        out = np.full(len(sizes), self.bias)
        some = np.flatnonzero(sizes)
        if len(some):
            starts = (np.cumsum(sizes) - sizes)[some]
            v = self.vectors[flat]
            s = np.add.reduceat(v, starts)
            out[some] += np.add.reduceat(self.weights[flat], starts) + 0.5 * (s * s - np.add.reduceat(v * v, starts)).sum(axis=1)
        return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-x))


def fit(hashes: np.ndarray, rows: list[np.ndarray], toxic: np.ndarray, weight: np.ndarray, rules: Toxicity) -> Machine:
    """A machine over hashes from documents' term numbers, by steps of falling size (the root of each number's summed squares)."""
    rng = np.random.default_rng(rules.seed)
    k = rules.factors
    share = float((weight * toxic).sum() / weight.sum())
    made = Machine(hashes, math.log(share / (1 - share)), np.zeros(len(hashes)), rng.normal(0, 0.05, (len(hashes), k)))
    theta = np.hstack([made.weights[:, None], made.vectors])
    seen, seen_bias = np.full_like(theta, 1e-6), 1e-6
    sizes = np.array([len(r) for r in rows])
    weight = weight / weight.mean()
    rate, decay = (np.array([x, *[y] * k]) for x, y in ((rules.weight_rate, rules.vector_rate), (rules.weight_decay, rules.vector_decay)))
    for _ in range(rules.epochs):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), rules.batch):
            some = order[lo : lo + rules.batch]
            n = sizes[some]
            flat = np.concatenate([rows[i] for i in some])
            made.weights, made.vectors = theta[:, 0], theta[:, 1:]
            gap = weight[some] * (sigmoid(made.logits(flat, n)) - toxic[some]) / len(some)
            seen_bias += gap.sum() ** 2
            made.bias -= rules.weight_rate * gap.sum() / math.sqrt(seen_bias)
            if not len(flat):
                continue
            own = np.repeat(np.arange(len(some)), n)
            sums = np.zeros((len(some), k))
            full = np.flatnonzero(n)
            sums[full] = np.add.reduceat(theta[flat, 1:], (np.cumsum(n) - n)[full])
            grad = gap[own][:, None] * np.hstack([np.ones((len(flat), 1)), sums[own] - theta[flat, 1:]])
            at, inverse = np.unique(flat, return_inverse=True)
            step = np.stack([np.bincount(inverse, weights=grad[:, j], minlength=len(at)) for j in range(k + 1)], axis=1) + decay * theta[at]
            seen[at] += step * step
            theta[at] -= rate * step / np.sqrt(seen[at])
    made.weights, made.vectors = theta[:, 0].copy(), theta[:, 1:].copy()
    return made


# ---------------------------------------------------------------- Spark


def labelled_documents(docs: DataFrame, labels: DataFrame, rules: Toxicity) -> DataFrame:
    """(doc_id, text, toxic) of the labelled documents of the training folds."""
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    if labels.count() <= rules.broadcast_rows:
        known = F.broadcast(known)
    return docs.select("doc_id", "text").where(~held_out(F.col("doc_id"), rules.folds)).join(known, "doc_id")


def learned(docs: DataFrame, labels: DataFrame, rules: Toxicity) -> Machine:
    spark = docs.sparkSession
    train = labelled_documents(docs, labels, rules)
    of = {r.toxic: r.n for r in train.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    total, toxic = of.get(0, 0) + of.get(1, 0), of.get(1, 0)
    none = np.zeros(0, dtype=np.int64)
    if not 0 < toxic < total:
        return Machine(none, math.inf if toxic else -math.inf, none.astype(float), np.zeros((0, rules.factors)))
    p = toxic / total
    z = (F.col("n_toxic") - F.col("n") * p) / F.sqrt(F.col("n") * (p * (1 - p)))
    strong = evidence(train).where(F.col("n") >= rules.least_docs).withColumn("z", z).where((F.col("z") >= rules.least_z) & (F.col("n_toxic") >= rules.least_lift * p * F.col("n")))
    hashes = np.array(sorted(r.term for r in strong.orderBy(F.desc("z"), "term").limit(rules.features).select("term").collect()), dtype=np.int64)
    shipped = spark.sparkContext.broadcast(hashes)

    def work(chunks):
        numbers = Terms(shipped.value)
        for chunk in chunks:
            yield {"toxic": chunk["toxic"], "terms": [numbers.of(words) for words in distinct_words(chunk["text"])]}

    # Of each label the rows of least hash.
    least = F.xxhash64(F.lit(rules.seed), "doc_id").cast("double") + 2.0**63
    wanted = F.when(F.col("toxic") == 1, min(1.0, rules.sample_rows / toxic)).otherwise(min(1.0, rules.sample_rows / (total - toxic)))
    got = map_batches(train.where(least <= wanted * 2.0**64), ["text", "toxic"], "toxic int, terms array<int>", work).toArrow()
    is_toxic = got.column("toxic").to_numpy().astype(np.float64)
    lists = pa.concat_arrays(got.column("terms").chunks) if got.num_rows else pa.array([], pa.list_(pa.int32()))
    flat, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
    rows = [flat[a:b].astype(np.int64) for a, b in zip(offsets[:-1], offsets[1:])]
    n_toxic = is_toxic.sum()
    if not 0 < n_toxic < len(rows):
        return Machine(none, math.log(p / (1 - p)), none.astype(float), np.zeros((0, rules.factors)))
    weight = np.where(is_toxic == 1, toxic / n_toxic, (total - toxic) / (len(rows) - n_toxic))
    return fit(hashes, rows, is_toxic, weight, rules)


def scored(docs: DataFrame, machine: Machine, rules: Toxicity = Toxicity()) -> DataFrame:
    """Per row of docs: doc_id, held_out, score and predicted."""
    shipped = docs.sparkSession.sparkContext.broadcast(machine)

    def work(chunks):
        made = shipped.value
        numbers = Terms(made.terms)
        for chunk in chunks:
            own = [numbers.of(words) for words in distinct_words(chunk["text"])]
            sizes = np.array([len(x) for x in own])
            score = sigmoid(made.logits(np.array([i for x in own for i in x], dtype=np.int64), sizes))
            yield {"doc_id": chunk["doc_id"], "held_out": chunk["held_out"], "score": score, "predicted": (score >= 0.5).astype(np.int32)}

    rows = docs.select("doc_id", "text", held_out(F.col("doc_id"), rules.folds).alias("held_out"))
    return map_batches(rows, ["doc_id", "text", "held_out"], "doc_id long, held_out boolean, score double, predicted int", work)


def toxicity(docs: DataFrame, labels: DataFrame, rules: Toxicity = Toxicity()) -> DataFrame:
    """Per row of docs: doc_id, held_out, score and predicted, learned from labels (doc_id, toxic)."""
    return scored(docs, learned(docs, labels, rules), rules)


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, learned from the labels of four folds of five."""
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {"op11_toxicity": op11_toxicity}
