"""Toxicity, lexical search and alignment against brute force, planted cases and held-out labels."""

import bisect
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestar.llm import alignment, lexical_search, toxicity
from lodestar.llm.common import documents

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
ODD = [
    (1, None), (2, ""), (3, " "), (4, "  "), (5, "a  b"), (6, " a"), (7, "a "), (8, "a\n b  c\n\n  d \n"), (9, "x▁y"), (10, "\nfoo"), (11, "日本語 😀 é \u0000 ünï"),
    (12, "<|endoftext|> <s> don't we'll"), (13, "x" * 3000), (14, "  a  b\u0085 c  d​ e"), (15, "a\x1c b\x1f c"), (16, "ﬁ ① ½"), (17, "a   \t  b"), (17, "a   \t  b"), (None, "hello  world   "),
    (18, "\r\n a\r\n b"), (19, "᠎ a᠎ b ﻿ c"), (20, "word " * 20_000),
]


# ---------------------------------------------------------------- op11


def test_machine_logits():
    """All pairs of a document's terms, by their vectors' products."""
    rng = np.random.default_rng(3)
    m = toxicity.Machine(np.arange(5), 0.1, rng.normal(size=5), rng.normal(size=(5, 3)))
    rows = [np.array([0, 2, 4]), np.array([], dtype=np.int64), np.array([1])]
    flat, sizes = np.concatenate(rows), np.array([3, 0, 1])
    want = [m.bias + m.weights[r].sum() + sum(m.vectors[i] @ m.vectors[j] for a, i in enumerate(r) for j in r[a + 1 :]) for r in rows]
    assert np.allclose(m.logits(flat, sizes), want)


def test_machine_learns_pairs():
    """Neither term alone is toxic, both together are: no weights of single terms can say that."""
    rng = np.random.default_rng(5)
    rows, toxic = [], []
    for _ in range(4000):
        a, b = (rng.random(2) < 0.5).astype(int)
        noise = 2 + np.flatnonzero(rng.random(20) < 0.2)
        rows.append(np.concatenate([[0] * a, [1] * b, noise]).astype(np.int64))
        toxic.append(float(a and b))
    made = toxicity.fit(np.arange(22), rows, np.array(toxic), np.ones(len(rows)), toxicity.Toxicity())
    case = lambda *t: toxicity.sigmoid(made.logits(np.array(t, dtype=np.int64), np.array([len(t)])))[0]
    assert case(0, 1, 7) > 0.5 > max(case(0, 7), case(1, 7), case(7), case())
    assert made.vectors[0] @ made.vectors[1] > 1


def test_evidence(spark):
    texts = [("Idiots here, idiots", 1), ("idiotic things", 1), ("nice things", 0), (None, 0), ("", 1)]
    got = {r.term: (r.n, r.n_toxic) for r in toxicity.evidence(spark.createDataFrame(texts, "text string, toxic int").repartition(2)).collect()}
    want = Counter()
    for text, y in texts:
        for h in {h for w in TERM.findall((text or "").lower()) for h in toxicity.word_terms(w.encode())}:
            want[h, 0] += 1
            want[h, 1] += y
    assert got == {h: (want[h, 0], want[h, 1]) for h, _ in want}
    assert got[toxicity.word_terms(b"idiots")[2]] == (2, 2)


def test_toxicity_held_out(spark, sf):
    d = sf.replace("0.001", "0.1")
    got = {r.doc_id: r for r in toxicity.op11_toxicity(spark, d).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in got.items())
    held = [(labels[i], got[i].predicted) for i in labels if got[i].held_out]
    tp, fp, fn = (held.count(x) for x in ((1, 1), (0, 1), (1, 0)))
    assert tp >= 0.85 * (tp + fn) and tp >= 0.9 * (tp + fp)


def test_toxicity_planted(spark, sf):
    """Insults put into clean documents, of any length, are found; the clean documents are left alone."""
    d = sf.replace("0.001", "0.1")
    docs = documents(spark, d)
    machine = toxicity.learned(docs, spark.read.parquet(f"{d}/labels.parquet"), toxicity.Toxicity())
    clean = docs.join(spark.read.parquet(f"{d}/labels.parquet").where("toxic = 0"), "doc_id").where("text <> ''").orderBy("doc_id").limit(600).select("doc_id", "text")
    planted = clean.select("doc_id", F.concat("text", F.lit(" what a worthless clown, you pathetic idiot")).alias("text"))
    assert toxicity.scored(clean, machine).where("predicted = 1").count() <= 6
    assert toxicity.scored(planted, machine).where("predicted = 1").count() >= 590


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    for labels, want in ([], 0.0), ([(1, 1)], 1.0), ([(1, 0), (2, None)], 0.0):
        got = toxicity.toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), toxicity.Toxicity(folds=1 << 20)).collect()
        assert [r.score for r in got] == [want] * 2


# ---------------------------------------------------------------- op12


def ranked(docs, items, k):
    """All scores by the rule."""
    split = lambda t: TERM.findall((t or "").translate(LOWER))
    held = [(i, split(t)) for i, t in docs]
    total, length = sum(bool(x) for _, x in held), sum(len(x) for _, x in held)
    df = Counter(w for _, x in held for w in set(x))
    weight = {w: math.floor(1000 * math.log((2 * total + 2) / (2 * n + 1))) for w, n in df.items()}
    counts = [(i, Counter(x), 10 + (90 * len(x) * total) // max(1, length)) for i, x in held]
    asked = defaultdict(set)
    for item, text in items:
        asked[item] |= set(split(text))
    out = []
    for item, words in asked.items():
        scores = [(-sum(weight[w] * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w in words if c[w]), i is None, i or 0) for i, c, m in counts]
        for rank, (score, null, i) in enumerate(sorted(x for x in scores if x[0] < 0)[:k], 1):
            out.append((item, rank, None if null else i, -score))
    return sorted(out, key=str)


@pytest.mark.parametrize("rules", [lexical_search.LexicalSearch(), lexical_search.LexicalSearch(k=3, shard_docs=300, block_terms=40), lexical_search.LexicalSearch(k=40, shard_postings=500)])
def test_search_on_random_rows(spark, rules):
    """Words from common to rare, ties by copies, odd rows: the same ranks as all scores give."""
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(200)] + ["Éa", "日本", "x1"]
    draw = lambda n: " ".join(words[min(len(words) - 1, int(x))] for x in rng.pareto(0.7, n))
    docs = [(i, draw(int(rng.integers(0, 60)))) for i in range(1500)] + [(5000 + i, "w0 w7 w9 w9") for i in range(300)] + ODD
    items = [(i, draw(12)) for i in range(12)] + [(20, None), (21, "zzz unseen"), (22, "W9, w9!w7"), (22, "w0"), (None, "w3 w150"), (23, " .,")]
    got = lexical_search.lexical_search(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), rules)
    assert sorted(map(tuple, got.collect()), key=str) == ranked(docs, items, rules.k)


def test_search_skips(monkeypatch):
    """Non-essential lists are probed for candidates only: a common term's postings aren't all looked at."""
    n = 20_000
    ids = np.arange(n)
    rare = np.arange(0, n, 500)
    term, doc = np.repeat([0, 1], [n, len(rare)]), np.concatenate([ids, rare])
    shard = lexical_search.Shard(ids, np.zeros(n, dtype=bool), term, doc, np.where(term == 1, 1000, 5).astype(np.int64))
    probed = []
    real = np.searchsorted
    monkeypatch.setattr(lexical_search.np, "searchsorted", lambda a, v, *x: (probed.append(np.size(v)), real(a, v, *x))[1])
    best = lexical_search.Best(10)
    shard.rank(np.array([0, 1]), best)
    assert best.scores.tolist() == [1005] * 10 and best.ids.tolist() == rare[:10].tolist()
    assert sum(p for p in probed if p > 2) < 100  # candidates of the essential list alone


def test_search_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical_search.lexical_search(none, items).collect() == []
    assert lexical_search.lexical_search(items.withColumnRenamed("item_id", "doc_id"), items.limit(0)).collect() == []


def test_search_own_text_first(spark, sf):
    """A document that holds an item whole is among its ten."""
    d = sf.replace("0.001", "0.01")
    items = {r.item_id: r.text for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()}
    docs = {r.doc_id: r.text or "" for r in documents(spark, d).collect()}
    got = defaultdict(set)
    for r in lexical_search.op12_lexical_search(spark, d).collect():
        got[r.item_id].add(r.doc_id)
    holders = {i: {k for k, t in docs.items() if text in t} for i, text in items.items()}
    found = [bool(got[i] & own) for i, own in holders.items() if own]
    assert sum(found) >= 0.95 * len(found)


# ---------------------------------------------------------------- op13


def aligned(rows):
    """Whole texts by both tokenizers, groups and links by offsets, counts by a dictionary."""
    a_model, b_model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    a_model.encode_special_tokens = True
    letters = alignment.byte_letters()
    piece = lambda p: bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode()
    found, pairs = [], Counter()
    for i, text in rows:
        a = a_model.encode(" " + text, add_special_tokens=False) if text else None
        b = b_model.encode(text) if text else []
        data_a, data_b = [bytes(letters[c] for c in t) for t in a.tokens] if text else [], [piece(b_model.id_to_piece(x)) for x in b]
        if not text or b"".join(data_a) != (" " + text).encode() or b"".join(data_b) != (" " + text).encode():
            found.append((i, 0, 0, 0, [], ""))
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in data_a]).tolist(), np.cumsum([len(x) for x in data_b]).tolist()
        cuts = sorted(set(ends_a) & set(ends_b))
        groups = [([], []) for _ in cuts]
        for side, (ids, ends) in enumerate(((a.ids, ends_a), (b, ends_b))):
            for x, e in zip(ids, ends):
                groups[bisect.bisect_left(cuts, e)][side].append(x)
        links = [(x[-1], y[-1]) for x, y in groups]
        pairs.update(links)
        said = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        found.append((i, len(a.ids), len(b), len(groups), links, hashlib.sha256(said.encode()).hexdigest()))
    best = Counter()
    for (_, y), n in pairs.items():
        best[y] = max(best[y], n)
    return sorted([(i, n_a, n_b, n, len(links), sum(pairs[p] == best[p[1]] for p in links), sum(pairs[p] for p in links), sha) for i, n_a, n_b, n, links, sha in found], key=str)


@pytest.mark.parametrize("salt_rows", [3, 20_000])
def test_alignment_of_odd_rows(spark, salt_rows):
    df = spark.createDataFrame(ODD, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, alignment.align(df, alignment.Alignment(salt_rows=salt_rows)).collect()), key=str) == aligned(ODD)


def test_alignment_of_documents(spark, sf, monkeypatch):
    """Small holds: sums are merged and handed on many times in a task."""
    monkeypatch.setattr(alignment, "HELD", 1000)
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 50_000)
    rows = [(r.doc_id, r.text) for r in documents(spark, sf).collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, alignment.align(df, alignment.Alignment(salt_rows=100)).collect()), key=str) == aligned(rows)


def test_units_join():
    for _, text in ODD:
        if text:
            assert "".join(alignment.units(text)) == " " + text
