"""Language-model scoring by context-tree weighting over bytes.

A text is the byte stream of its words (A-Z lower-cased), a space behind each, and one line feed for the
end. Every byte is eight binary decisions; every decision is predicted in the contexts of the last 0 to ``depth`` bytes by
Krichevsky-Trofimov estimates, and context-tree weighting mixes all depths: with P_e the KT block probability of a
node and P_w(s) = (P_e(s) + prod P_w(children of s)) / 2, the next decision has probability w KT(s) + (1 - w) p(child),
w = P_e / (2 P_w). The model is frozen after training; score is the log10 probability of the stream under it, so
-score / log10(2) / bytes is the code length per byte.

Training counts are of (context, byte) grams and are summed by Spark. Nodes of depth 2 and more are worked out
in groups of whole pairs of last bytes, those of more than SPLIT_GRAMS grams a pair in groups of whole triples, of 65,536 grams each at most; depth 1 is a plain aggregate of those, of 256 times 255 nodes at most. Scoring looks up a table of grams: the frequent ones (a share of 1 / 2**heavy_bits or more each, so 2**heavy_bits at most) are
broadcast, all others travel as rows to a join; nothing is left out. Words for the unigram base score go the same way.

Null text counts as empty: a stream of one end. Repeated rows are scored alike, row by row. With no training documents
every byte has probability 2**-8. An empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import uuid
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import documents, map_batches, stored, worker_cache
from lodestar.llm.language_id import held_out

END = b"\n"
#: Distinct words, and grams, that a task holds before it emits their counts.
HELD = 400_000
#: Bytes of text whose grams a task counts, and scores, at a time: arrays of some 100 bytes for each.
COUNTED_BYTES, SCORED_BYTES = 2 << 20, 1 << 20
#: Mean number of grams that are weighted together.
GROUP_GRAMS = 50_000
#: Grams of a pair of last bytes from which it is split.
SPLIT_GRAMS = 200_000


@dataclass(frozen=True)
class ContextTree:
    """folds, held: documents whose crc32 is held modulo folds aren't learned from; depth: bytes of context."""

    folds: int = 7
    held: int = 2
    depth: int = 4
    heavy_words_bits: int = 17
    heavy_grams_bits: int = 22


# ---------------------------------------------------------------- streams and grams


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def grams(texts: list[list[bytes]], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Gram of each byte of the streams of texts, and the number of its text. A gram has the context, latest
    byte first, and the byte itself last; a stream starts after line feeds."""
    pad = END * depth
    streams = [b" ".join([*words, END]) for words in texts]
    data = np.frombuffer(pad + pad.join(streams), dtype=np.uint8).astype(np.int64)
    sizes = np.array([len(s) for s in streams])
    n = len(data)
    keys = np.zeros(n - depth, dtype=np.int64)
    for back in range(1, depth + 1):
        keys |= data[depth - back : n - back] << (8 * (depth + 1 - back))
    keys |= data[depth:]
    owner = np.repeat(np.arange(2 * len(sizes) - 1), np.stack([sizes, np.full(len(sizes), depth)], axis=1).ravel()[:-1])
    own = owner % 2 == 0
    return keys[own], owner[own] // 2


def gram_bytes(keys: np.ndarray) -> pa.Array:
    """b"g" and eight bytes for each key."""
    data = np.empty((len(keys), 9), dtype=np.uint8)
    data[:, 0] = ord("g")
    data[:, 1:] = keys.astype(">i8").view(np.uint8).reshape(-1, 8)
    offsets = np.arange(0, 9 * len(keys) + 1, 9, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def gram_of(key: str) -> Column:
    """The number behind the first byte of a key."""
    return F.conv(F.hex(F.substring(key, 2, 8)), 16, 10).cast("long").alias("gram")


def merge(a: tuple, b: tuple) -> tuple:
    """Sums of two (sorted keys, columns of counts)."""
    keys, inverse = np.unique(np.concatenate([a[0], b[0]]), return_inverse=True)
    both = np.concatenate([a[1], b[1]])
    return keys, np.stack([np.bincount(inverse, weights=both[:, c], minlength=len(keys)) for c in range(both.shape[1])], axis=1).astype(np.int64)


def counts(docs: DataFrame, rules: ContextTree) -> DataFrame:
    """(key, n_all, n_train) of all words (b"w" in front; the end is b"w" alone) and grams (b"g" in front)."""

    def work(chunks):
        words = [Counter(), Counter()]
        nothing = (np.zeros(0, dtype=np.int64), np.zeros((0, 2), dtype=np.int64))
        seen = nothing

        def emit_words():
            both = list(words[0].keys() | words[1].keys())
            train = [words[1].get(w, 0) for w in both]
            out = {"key": [b"w" + w for w in both], "n_all": [words[0].get(w, 0) + t for w, t in zip(both, train)], "n_train": train}
            words[0].clear()
            words[1].clear()
            return out

        for chunk in chunks:
            for learned in (False, True):
                texts = [words_of(t) for t, out in zip(chunk["text"], chunk["held_out"]) if out != learned]
                if not texts:
                    continue
                for some in texts:
                    words[learned].update(some)
                words[learned][b""] += len(texts)
                found, n = np.unique(grams(texts, rules.depth)[0], return_counts=True)
                seen = merge(seen, (found, np.stack([n, n * learned], axis=1)))
            if len(words[0]) + len(words[1]) > HELD:
                yield emit_words()
            if len(seen[0]) > HELD:
                yield {"key": gram_bytes(seen[0]), "n_all": seen[1][:, 0], "n_train": seen[1][:, 1]}
                seen = nothing
        if words[0] or words[1]:
            yield emit_words()
        if len(seen[0]):
            yield {"key": gram_bytes(seen[0]), "n_all": seen[1][:, 0], "n_train": seen[1][:, 1]}

    rows = docs.select("text", held_out(F.col("doc_id"), rules.folds, rules.held).alias("held_out"))
    return map_batches(rows, ["text", "held_out"], "key binary, n_all long, n_train long", work, COUNTED_BYTES).groupBy("key").agg(F.sum("n_all").alias("n_all"), F.sum("n_train").alias("n_train"))


# ---------------------------------------------------------------- weighting


def log_gamma(z: np.ndarray) -> np.ndarray:
    """For z > 0: Stirling's series, eight steps up."""
    up = z + 8
    series = (up - 0.5) * np.log(up) - up + 0.5 * np.log(2 * np.pi) + 1 / (12 * up) - 1 / (360 * up**3) + 1 / (1260 * up**5)
    return series - np.log(np.multiply.reduce([z + i for i in range(8)]))


def log_block(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """log of the KT probability of a sequence with n0 zeros and n1 ones."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1.0) - np.log(np.pi)


def estimate(n0, n1, bit):
    return (np.where(bit, n1, n0) + 0.5) / (n0 + n1 + 1.0)


def weighted(n0: np.ndarray, n1: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log P_w of nodes with the log-sum of their children below, and the weight w of their own estimate."""
    own, under = np.log(0.5) + log_block(n0, n1), np.log(0.5) + below
    total = np.logaddexp(own, under)
    return total, np.exp(own - total)


class Level:
    """The nodes of one context length: for each place in a byte, (context, byte so far) and its counts."""

    def __init__(self, context: np.ndarray, byte: np.ndarray, n: np.ndarray):
        pairs, self.of_row = np.unique(context << 8 | byte, return_inverse=True)
        total = np.bincount(self.of_row, weights=n, minlength=len(pairs))
        byte = pairs & 255
        self.keys, self.n0, self.n1, self.of_pair = [], [], [], []
        for k in range(8):
            prefix = (1 << k) | (byte >> (8 - k))
            keys, of = np.unique((pairs >> 8) << 8 | prefix, return_inverse=True)
            bit = (byte >> (7 - k)) & 1
            self.keys.append(keys)
            self.n0.append(np.bincount(of, weights=total * (1 - bit), minlength=len(keys)))
            self.n1.append(np.bincount(of, weights=total * bit, minlength=len(keys)))
            self.of_pair.append(of)

    def node(self, k: int) -> np.ndarray:
        """The node of each row at place k."""
        return self.of_pair[k][self.of_row]


def weigh(key: np.ndarray, n: np.ndarray, depth: int, top: int) -> tuple[np.ndarray, Level, list[np.ndarray]]:
    """Mixes the contexts of top to depth bytes. key: grams; n: training counts. Gives, for each gram and place,
    the probability of its bit in the context of top bytes, the nodes of that length, and their log P_w."""
    byte = key & 255
    bits = [(byte >> (7 - k)) & 1 for k in range(8)]
    deeper: tuple[Level, list[np.ndarray]] | None = None
    weights = {}
    for d in range(depth, top - 1, -1):
        level = Level(key >> (8 * (depth - d + 1)), byte, n)
        logs, own = [], []
        for k in range(8):
            if deeper is None:
                logs.append(log_block(level.n0[k], level.n1[k]))
                continue
            parents = np.searchsorted(level.keys[k], (deeper[0].keys[k] >> 16) << 8 | (deeper[0].keys[k] & 255))
            log, w = weighted(level.n0[k], level.n1[k], np.bincount(parents, weights=deeper[1][k], minlength=len(level.keys[k])))
            logs.append(log)
            own.append(w)
        weights[d] = (level, own)
        deeper = (level, logs)
    p = np.empty((len(key), 8))
    for d in range(depth, top - 1, -1):
        level, own = weights[d]
        for k in range(8):
            node = level.node(k)
            kt = estimate(level.n0[k][node], level.n1[k][node], bits[k])
            p[:, k] = kt if d == depth else own[k][node] * kt + (1 - own[k][node]) * p[:, k]
    return p, *deeper


WEIGHTED = "gram long, node int, n0 double, n1 double, log_pw double, p array<double>"


def mixer(depth: int, top: int):
    """A function of tables of grams that gives rows of grams with their p in the contexts of top to depth bytes, then rows of the nodes of top bytes, which have none."""

    def mix(table: pa.Table) -> pa.Table:
        key = table.column("gram").to_numpy()
        p, level, logs = weigh(key, table.column("n_train").to_numpy(), depth, top)
        nodes, none = np.concatenate(level.keys), np.zeros(len(key))
        ends = np.full(len(key) + len(nodes) + 1, p.size, dtype=np.int32)
        ends[: len(key)] = np.arange(0, p.size, 8)
        return pa.table({
            "gram": np.concatenate([key, nodes >> 8]), "node": np.concatenate([none, nodes & 255]).astype(np.int32),
            "n0": np.concatenate([none, *level.n0]), "n1": np.concatenate([none, *level.n1]), "log_pw": np.concatenate([none, *logs]),
            "p": pa.ListArray.from_arrays(ends, p.ravel()),
        })

    return mix


def _with_p(batch: pa.RecordBatch, p: np.ndarray) -> pa.RecordBatch:
    ends = np.arange(0, p.size + 1, 8, dtype=np.int32)
    return batch.set_column(batch.schema.get_field_index("p"), "p", pa.ListArray.from_arrays(ends, p.ravel()))


def split_pairs(grams_of: DataFrame, depth: int, groups: int) -> DataFrame:
    """The rows that mixer(depth, 2) gives, of pairs of last bytes with many grams: groups hold whole triples of last bytes, of 65,536 grams each at
    most, and the nodes of pairs are sums over theirs. The weights of pairs travel by broadcast, a few kilobytes for each pair of SPLIT_GRAMS grams or more."""
    spark = grams_of.sparkSession
    triple = F.pmod(F.xxhash64(F.shiftright("gram", 8 * (depth - 2))), F.lit(groups))
    deep = stored(grams_of.groupBy(triple.alias("of")).applyInArrow(mixer(depth, 3), WEIGHTED), "ctw-triples")
    sums = deep.where("node > 0").groupBy(F.shiftright("gram", 8).alias("gram"), "node").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("log_pw").alias("log_pw"))
    sums = stored(sums.withColumn("p", F.lit(None).cast("array<double>")), "ctw-split")

    def weight(batches):
        for batch in batches:
            total, _ = weighted(*(batch.column(c).to_numpy() for c in ("n0", "n1", "log_pw")))
            yield batch.set_column(batch.schema.get_field_index("log_pw"), "log_pw", pa.array(total))

    found = sums.select("gram", "node", "n0", "n1", "log_pw").toArrow()
    pairs, at = np.unique(found.column("gram").to_numpy(), return_inverse=True)
    node = found.column("node").to_numpy()
    n0, n1, w = (np.zeros((len(pairs), 256)) for _ in range(3))
    n0[at, node], n1[at, node] = found.column("n0").to_numpy(), found.column("n1").to_numpy()
    w[at, node] = weighted(n0[at, node], n1[at, node], found.column("log_pw").to_numpy())[1]
    shipped = spark.sparkContext.broadcast((pairs, n0, n1, w))

    def combine(batches):
        pairs, n0, n1, w = shipped.value
        for batch in batches:
            key = batch.column("gram").to_numpy()
            p = np.array(batch.column("p").flatten()).reshape(-1, 8)
            row, byte = np.searchsorted(pairs, key >> (8 * (depth - 1))), key & 255
            for k in range(8):
                node, bit = (1 << k) | (byte >> (8 - k)), (byte >> (7 - k)) & 1
                p[:, k] = w[row, node] * estimate(n0[row, node], n1[row, node], bit) + (1 - w[row, node]) * p[:, k]
            yield _with_p(batch, p)

    return deep.where("node = 0").mapInArrow(combine, WEIGHTED).unionByName(sums.select(deep.columns).mapInArrow(weight, WEIGHTED))


def model(tally: DataFrame, rules: ContextTree) -> DataFrame:
    """(key, ctw): log10 probability of each gram's byte in its context, for the grams of tally."""
    depth = rules.depth
    some = tally.where(F.substring("key", 1, 1) == F.lit(b"g")).select(gram_of("key"), "n_train")
    # Pairs of last bytes are dealt to as many groups as keep each near GROUP_GRAMS; there are 65,536 pairs at most.
    groups = max(8, some.count() // GROUP_GRAMS)
    pair = F.shiftright("gram", 8 * (depth - 1))
    large = [r.pair for r in some.groupBy(pair.alias("pair")).count().where(F.col("count") > SPLIT_GRAMS).collect()] if depth > 2 else []
    whole = some.where(~pair.isin(large)) if large else some
    pairs = whole.groupBy(F.pmod(F.xxhash64(pair), F.lit(groups)).alias("of")).applyInArrow(mixer(depth, 2), WEIGHTED)
    if large:
        pairs = pairs.unionByName(split_pairs(some.where(pair.isin(large)), depth, groups))
    pairs = stored(pairs, "ctw-pairs")

    # Depth 1: sums over the second last byte, so plain aggregates; 256 * 255 rows at most.
    ones = (
        pairs.where("node > 0")
        .groupBy(F.shiftright("gram", 8).cast("int").alias("last"), "node")
        .agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("log_pw").alias("below"))
        .toPandas()
        .sort_values(["last", "node"])
    )
    w1, n1_0, n1_1, log1 = (np.zeros((256, 256)) for _ in range(4))
    at = ones["last"].to_numpy(), ones["node"].to_numpy()
    n1_0[at], n1_1[at] = ones["n0"], ones["n1"]
    log1[at], w1[at] = weighted(ones["n0"].to_numpy(), ones["n1"].to_numpy(), ones["below"].to_numpy())
    n0_0, n0_1 = n1_0.sum(axis=0), n1_1.sum(axis=0)
    _, w0 = weighted(n0_0, n0_1, log1.sum(axis=0))

    def finish(batches):
        for batch in batches:
            key = batch.column("gram").to_numpy()
            p = np.array(batch.column("p").flatten()).reshape(-1, 8)
            last, byte = key >> (8 * depth), key & 255
            total = np.zeros(len(key))
            for k in range(8):
                node, bit = (1 << k) | (byte >> (8 - k)), (byte >> (7 - k)) & 1
                w = w1[last, node]
                one = w * estimate(n1_0[last, node], n1_1[last, node], bit) + (1 - w) * p[:, k]
                total += np.log10(w0[node] * estimate(n0_0[node], n0_1[node], bit) + (1 - w0[node]) * one)
            yield pa.RecordBatch.from_arrays([gram_bytes(key), pa.array(total)], names=["key", "ctw"])

    return pairs.where("node = 0").select("gram", "p").mapInArrow(finish, "key binary, ctw double")


# ---------------------------------------------------------------- scoring


class Lookup:
    """Values of 64-bit keys by open addressing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(2 * len(keys) + 1))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, dtype=np.int64)
        self.values = np.full(1 << bits, np.nan)
        left = np.arange(len(keys))
        at = self.slot(keys)
        while len(left):
            free = self.keys[at[left]] == -1
            some = left[free]
            self.keys[at[some]] = keys[some]
            won = self.keys[at[some]] == keys[some]
            self.values[at[some[won]]] = values[some[won]]
            left = np.concatenate([left[~free], some[~won]])
            at[left] = (at[left] + 1) & self.mask

    def slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Values, NaN where there is none."""
        at = self.slot(keys)
        out = self.values[at]
        found = self.keys[at]
        left = np.flatnonzero((found != keys) & (found != -1))
        out[found != keys] = np.nan
        while len(left):
            at[left] = (at[left] + 1) & self.mask
            found = self.keys[at[left]]
            hit = found == keys[left]
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (found != -1)]
        return out


def context_tree_score(docs: DataFrame, rules: ContextTree = ContextTree()) -> DataFrame:
    """Per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes and
    bits_per_byte."""
    spark = docs.sparkSession
    tally = stored(counts(docs, rules), "ctw-counts")
    is_word = F.substring("key", 1, 1) == F.lit(b"w")
    r = tally.agg(
        *[F.coalesce(F.sum(F.when(kind, F.col(c))), F.lit(0)).alias(f"{c}_{name}") for c in ("n_all", "n_train") for name, kind in (("words", is_word), ("grams", ~is_word))],
        F.count(F.when(is_word & (F.col("n_train") > 0), 1)).alias("distinct"),
    ).first()
    n_train, n_distinct = r.n_train_words, r.distinct
    base = F.log10((F.col("n_train") + 1) / F.lit(float(n_train + n_distinct + 1)))
    words = tally.where(is_word).select("key", "n_all", base.alias("base"), F.lit(0.0).alias("ctw"), (F.col("n_train") > 0).cast("long").alias("known"))
    table = words.unionByName(model(tally, rules).join(tally.select("key", "n_all"), "key").select("key", "n_all", F.lit(0.0).alias("base"), "ctw", F.lit(0).cast("long").alias("known")))
    table = stored(table, "ctw-table")
    # Each has a share of 2 ** -bits or more of all, so there are 2 ** bits at most.
    heavy_words = table.where((F.substring("key", 1, 1) == F.lit(b"w")) & (F.col("n_all") * F.lit(1 << rules.heavy_words_bits) >= r.n_all_words)).select("key", "base", "known").toArrow()
    heavy_grams = table.where((F.substring("key", 1, 1) == F.lit(b"g")) & (F.col("n_all") * F.lit(1 << rules.heavy_grams_bits) >= r.n_all_grams)).select(gram_of("key"), "ctw").toArrow()
    shipped = spark.sparkContext.broadcast((
        uuid.uuid4().hex,
        [k[1:] for k in heavy_words.column("key").to_pylist()],
        heavy_words.column("base").to_numpy(), heavy_words.column("known").to_numpy(),
        heavy_grams.column("gram").to_numpy(), heavy_grams.column("ctw").to_numpy(),
    ))

    def work(chunks):
        tag, word_keys, word_base, word_known, keys, values = shipped.value
        cache = worker_cache()
        if cache.get("ctw", (None,))[0] != tag:
            cache["ctw"] = (tag, {w: i for i, w in enumerate(word_keys)}, Lookup(keys, values))
        _, numbers, known_grams = cache["ctw"]
        row0 = TaskContext.get().partitionId() << 33
        word_base, word_known = np.append(word_base, 0.0), np.append(word_known, 0)
        for chunk in chunks:
            texts = [words_of(t) for t in chunk["text"]]
            size = len(texts)
            rows, keys_out, n_out = [], [], []
            n_tokens = np.array([len(t) + 1 for t in texts])
            base, known = np.zeros(size), np.zeros(size, dtype=np.int64)
            get = numbers.get
            for i, some in enumerate(texts):
                some = [*some, b""]
                found = np.fromiter([get(w, -1) for w in some], dtype=np.int64, count=len(some))
                base[i], known[i] = word_base[found].sum(), word_known[found].sum()
                missing = np.flatnonzero(found < 0)
                if len(missing):
                    rest = Counter([some[j] for j in missing.tolist()])
                    rows += [row0 + i] * len(rest)
                    keys_out += [b"w" + w for w in rest]
                    n_out += rest.values()
            gram, owner = grams(texts, rules.depth)
            value = known_grams.find(gram)
            unknown = np.isnan(value)
            score = np.bincount(owner, weights=np.where(unknown, 0, value), minlength=size)
            n_bytes = np.bincount(owner, minlength=size)
            left, n = np.unique(np.stack([owner[unknown], gram[unknown]]), axis=1, return_counts=True)
            every = np.arange(size)
            for part in (
                {"row": row0 + every, "doc_id": chunk["doc_id"], "held_out": chunk["held_out"], "key": [b"d" + int(row0 + i).to_bytes(8, "big") for i in every], "n": np.ones(size, dtype=np.int64), "n_tokens": n_tokens, "known0": known, "base0": base, "score0": score, "n_bytes": n_bytes},
                _rest(rows, pa.array(keys_out, type=pa.binary()), n_out),
                _rest(row0 + left[0], gram_bytes(left[1]), n),
            ):
                if len(part["row"]):
                    yield part
            row0 += size

    rows = docs.select("doc_id", "text", held_out(F.col("doc_id"), rules.folds, rules.held).alias("held_out"))
    schema = "row long, doc_id long, held_out boolean, key binary, n long, n_tokens long, known0 long, base0 double, score0 double, n_bytes long"
    parts = map_batches(rows, ["doc_id", "text", "held_out"], schema, work, SCORED_BYTES)
    # A document's own row has a key that no table row has. Frequent keys aren't among the others.
    joined = parts.join(table.select("key", "base", "ctw", "known"), "key", "left")
    total = joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.bool_or("held_out").alias("held_out"),
        F.max("n_tokens").alias("n_tokens"),
        (F.sum("known0") + F.coalesce(F.sum(F.col("known") * F.col("n")), F.lit(0))).alias("n_known"),
        (F.sum("base0") + F.coalesce(F.sum(F.col("base") * F.col("n")), F.lit(0.0))).alias("base_score"),
        (F.sum("score0") + F.coalesce(F.sum(F.col("ctw") * F.col("n")), F.lit(0.0))).alias("score"),
        F.max("n_bytes").alias("n_bytes"),
    )
    return total.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score", "n_bytes",
        (-F.col("score") / F.lit(float(np.log10(2))) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def _rest(rows, keys, n) -> dict:
    """Rows that carry keys alone."""
    none = [None] * len(rows)
    zeros = np.zeros(len(rows))
    return {"row": rows, "doc_id": none, "held_out": none, "key": keys, "n": n, "n_tokens": none, "known0": zeros.astype(np.int64), "base0": zeros, "score0": zeros, "n_bytes": none}


def op6_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, learned from six folds of seven."""
    return context_tree_score(documents(spark, sf_dir))


QUERIES = {"op6_context_tree": op6_context_tree}
