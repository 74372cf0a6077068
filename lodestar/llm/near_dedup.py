"""MinHash near-duplicates by tensored banding, with every link verified on full shingle sets.

Signatures hold two small collections of keys, A and B, of ``half`` minhashes each. A table key is a pair (A_i, B_j), so
``bands``**2 tables of 2 * half minhashes come from 2 * half * bands minhashes, about the square root of what independent
tables would take. ``bands`` follows from the threshold: a pair just at it is missed with probability ``miss`` at most.

Documents with equal sets are one node (their smallest doc_id) from the start. Keys that one node alone has are dropped
before tables are formed. Candidates are verified in two rounds, so that a large group of near copies isn't expanded into all its
pairs: first each node against the leaders (smallest nodes) it shares most tables with; then, within each table key, only
pairs that the links so far leave in different components, all of them. A key of many nodes is dealt as pairs of blocks of ``block`` nodes,
so no task gets all pairs of a key. Components of the verified links are found by label
propagation with pointer jumping over stored tables. A link inside a component can't change it, so no link between components is lost
but those that no table nominates.

A document's set: distinct shingles of ``words`` words, A-Z lower-cased; with fewer words, all of them as one; without
words or text, empty and linked with nothing. Shingles are held as 64-bit hashes. Rows that share a doc_id are one document, so
linked; rows without doc_id are linked with nothing and kept. Repeated rows get equal results. An empty table gives no rows.
Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.llm.common import documents, map_batches, stored

#: Values of minhash arrays that are formed at a time.
SLICE = 1 << 20
#: 64-bit numbers of an odd sketch.
SKETCH_LONGS = 16


@dataclass(frozen=True)
class NearDedup:
    """percent: least Jaccard similarity; half: minhashes of a sub-key; miss: chance to miss a pair at the threshold;
    first_leaders: candidates of a node in the first round (the rest come in the second); block: nodes of a key that meet as
    many others in one task."""

    words: int = 5
    percent: int = 80
    half: int = 3
    miss: float = 1e-5
    first_leaders: int = 2
    block: int = 1000
    seed: int = 1

    @property
    def bands(self) -> int:
        return math.ceil(math.log(self.miss / 2) / math.log(1 - (self.percent / 100) ** self.half))


def _mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: list[bytes | None], words: int) -> list[np.ndarray]:
    """The sorted set of shingle hashes of each text."""
    import xxhash

    split = [(t or b"").lower().split() for t in texts]
    index: dict[bytes, int] = {}
    ids = np.array([index.setdefault(w, len(index)) for some in split for w in some], dtype=np.int64)
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in index), dtype=np.uint64, count=len(index))
    stream = hashes[ids] if len(ids) else np.zeros(0, dtype=np.uint64)
    factors = _mixed(np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(0, len(stream) - words + 1), dtype=np.uint64)
        for j in range(words):
            rolled += stream[j : j + len(rolled)] * factors[j]
        rolled = _mixed(rolled)
        out, at = [], 0
        for some in split:
            n = len(some)
            if n >= words:
                out.append(np.unique(rolled[at : at + n - words + 1]))
            else:
                short = (stream[at : at + n] * factors[:n]).sum(dtype=np.uint64) + np.uint64(n)
                out.append(_mixed(np.array([short], dtype=np.uint64)) if n else np.zeros(0, dtype=np.uint64))
            at += n
    return out


def minhashes(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of a * v + b over values, for each (a, b)."""
    out = np.full(len(a), np.iinfo(np.uint64).max, dtype=np.uint64)
    step = max(1, SLICE // len(a))
    with np.errstate(over="ignore"):
        for lo in range(0, len(values), step):
            out = np.minimum(out, (values[lo : lo + step, None] * a + b).min(axis=0))
    return out


def odd_sketch(values: np.ndarray) -> np.ndarray:
    """A bit for each of 64 * SKETCH_LONGS classes of hashes: whether it has an odd number of the values. Sketches of two sets
    differ in as many bits at most as the sets differ in values."""
    odd = np.bincount((values >> np.uint64(20)).astype(np.int64) % (64 * SKETCH_LONGS), minlength=64 * SKETCH_LONGS) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


def signatures(docs: DataFrame, rules: NearDedup) -> DataFrame:
    """doc_id, n_shingles, digest of the set (null: empty set), the 2 * bands sub-keys, A before B, and the odd sketch."""
    rng = np.random.default_rng(rules.seed)
    count = 2 * rules.bands * rules.half
    a = rng.integers(0, 1 << 63, size=count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, size=count, dtype=np.uint64)
    fold = _mixed(np.arange(1, rules.half + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)

    def work(chunks):
        for chunk in chunks:
            sets = shingle_sets(chunk["text"], rules.words)
            keys = []
            for s in sets:
                if not len(s):
                    keys.append(None)
                    continue
                with np.errstate(over="ignore"):
                    keys.append(_mixed((minhashes(s, a, b).reshape(-1, rules.half) * fold).sum(axis=1, dtype=np.uint64)).view(np.int64))
            yield {"doc_id": chunk["doc_id"], "n_shingles": [len(s) for s in sets], "digest": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], "keys": keys, "sketch": [odd_sketch(s) if len(s) else None for s in sets]}

    return map_batches(docs, ["doc_id", "text"], "doc_id long, n_shingles long, digest binary, keys array<bigint>, sketch array<bigint>", work)


def full_sets(docs: DataFrame, wanted: DataFrame, rules: NearDedup) -> DataFrame:
    """(node, shingles) of the nodes of wanted (node, digest), from their texts."""
    rows = docs.select("doc_id", "text").join(wanted, F.col("doc_id") == F.col("node")).select("node", "text", "digest")

    def work(chunks):
        for chunk in chunks:
            sets = shingle_sets(chunk["text"], rules.words)
            own = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() == d for s, d in zip(sets, chunk["digest"])]
            yield {"node": [n for n, o in zip(chunk["node"], own) if o], "shingles": [s.view(np.int64) for s, o in zip(sets, own) if o]}

    return map_batches(rows, ["node", "text", "digest"], "node long, shingles array<bigint>", work)


def can_link(x: str, y: str, percent: int) -> Column:
    """Whether the sets of two nodes, with columns n and sketch under the prefixes x and y, can be similar enough. Exact: sets
    that are differ in (100 - percent) / (100 + percent) of their shingles at most, and sketches in no more bits."""
    n, m = F.col(f"{x}n"), F.col(f"{y}n")
    apart = sum((F.bit_count(F.get(f"{x}sketch", F.lit(i)).bitwiseXOR(F.get(f"{y}sketch", F.lit(i)))) for i in range(SKETCH_LONGS)), F.lit(0))
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * apart <= (100 - percent) * (n + m))


def verified(pairs: DataFrame, sets: DataFrame, rules: NearDedup) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    shared = both.select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("both"), (F.size("sa") + F.size("sb")).alias("all"))
    return shared.where(100 * F.col("both") >= rules.percent * (F.col("all") - F.col("both"))).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over links (a, b), for all nodes that have a link.

    Each round takes the least label among neighbours, then the label's label. Tables are stored each round, so
    lineage stays short and a lost executor costs one round at most.
    """
    edges = stored(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(edges.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("component")), "labels")
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("least"))
        hooked = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("component").alias("old"), F.least("component", "least").alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        new = stored(hooked.join(jump, "component", "left").select("node", "old", F.least("component", F.coalesce("further", "component")).alias("component")), "labels")
        labels = new.select("node", "component")
        if new.where("old <> component").isEmpty():
            return labels


def table_rows(nodes: DataFrame, rules: NearDedup) -> DataFrame:
    """(key, i, j, node) for each table key that more than one node may have."""
    m = rules.bands
    subs = nodes.select("node", F.posexplode("keys").alias("at", "sub"))
    shared = subs.groupBy("at", "sub").agg(F.count("*").alias("n")).where("n > 1").select("at", "sub")
    live = subs.join(shared, ["at", "sub"], "left_semi").groupBy("node").agg(F.collect_set(F.struct("at", "sub")).alias("live"))
    parts = live.select("node", F.filter("live", lambda x: x["at"] < m).alias("live_a"), F.filter("live", lambda x: x["at"] >= m).alias("live_b"))
    rows = parts.select("node", "live_b", F.explode("live_a").alias("x")).select("node", "x", F.explode("live_b").alias("y"))
    return rows.select(F.xxhash64("x.at", "y.at", "x.sub", "y.sub").alias("key"), F.col("x.at").cast("short").alias("i"), (F.col("y.at") - m).cast("short").alias("j"), "node")


def near_dedup(docs: DataFrame, rules: NearDedup = NearDedup()) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id and kept."""
    signed = stored(signatures(docs, rules), "signatures")
    has = signed.where(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    # Equal sets are one node from here on.
    nodes = stored(has.groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch")), "nodes")
    size = nodes.select("node", "n", "sketch")
    rows = stored(table_rows(nodes, rules), "tables")

    # First round: leaders by the number of tables shared.
    leaders = rows.groupBy("key").agg(F.min("node").alias("leader"), F.max("node").alias("last")).where("leader < last").select("key", "leader")
    stars = stored(rows.join(leaders, "key").where("node > leader").groupBy("node", "leader").agg(F.count("*").alias("tables")), "stars")
    wanted = stars.select("node").union(stars.select("leader")).distinct().join(nodes.select("node", "digest"), "node")
    sets = stored(full_sets(docs, wanted, rules), "sets")
    by_tables = Window.partitionBy("node").orderBy(F.desc("tables"), "leader")
    fit = stars.join(size, "node").join(size.select(F.col("node").alias("leader"), F.col("n").alias("leader_n"), F.col("sketch").alias("leader_sketch")), "leader").where(can_link("", "leader_", rules.percent))
    first = fit.withColumn("place", F.row_number().over(by_tables)).where(F.col("place") <= rules.first_leaders).select(F.col("leader").alias("a"), F.col("node").alias("b"))
    links = stored(verified(first, sets, rules), "links-1")
    found = components(links)

    # Second round: in each table, pairs across the components so far.
    placed = rows.join(found, "node", "left").select("key", "i", "j", "node", F.coalesce("component", "node").alias("of"))
    held = placed.groupBy("key", "of").agg(F.count("*").alias("n"))
    largest = held.groupBy("key").agg(F.max_by("of", F.struct("n", "of")).alias("largest"), F.count("*").alias("k"), F.sum("n").alias("nodes")).where("k > 1").select("key", "largest", F.ceil(F.col("nodes") / rules.block).cast("int").alias("blocks"))
    with_keys = nodes.select("node", "n", "sketch", F.slice("keys", 1, rules.bands).alias("ka"), F.slice("keys", rules.bands + 1, rules.bands).alias("kb"))
    mixed = stored(placed.join(largest, "key").join(with_keys, "node"), "mixed")
    # One side leaves out the table's largest component, so that is never paired with itself.
    own, every = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    x = mixed.where("of <> largest").withColumns({"at_x": own, "at_y": every}).alias("x")
    y = mixed.withColumns({"at_y": own, "at_x": every}).alias("y")
    same = lambda c, at: F.array_position(F.zip_with(f"x.{c}", f"y.{c}", lambda p, q: p == q), True) == F.col(f"x.{at}") + 1
    once = (F.col("y.of") == F.col("y.largest")) | (F.col("x.node") < F.col("y.node"))
    across = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.at_x") == F.col("y.at_x")) & (F.col("x.at_y") == F.col("y.at_y")) & (F.col("x.of") != F.col("y.of")) & once & can_link("x.", "y.", rules.percent) & same("ka", "i") & same("kb", "j"))
    pairs = across.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
    more = stored(verified(pairs.join(first, ["a", "b"], "left_anti"), sets, rules), "links-2")
    if not more.isEmpty():
        # Components of components.
        of = found.select(F.col("node").alias("a"), F.col("component").alias("ca"))
        joined = more.join(of, "a", "left").join(of.select(F.col("a").alias("b"), F.col("ca").alias("cb")), "b", "left")
        upper = components(joined.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
        touched = found.select("node").union(more.select("a")).union(more.select("b")).distinct().join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
        found = touched.join(upper.select(F.col("node").alias("component"), F.col("component").alias("upper")), "component", "left").select("node", F.coalesce("upper", "component").alias("component"))

    # A doc_id with two sets may be part of two nodes; what it reaches is the least of them.
    per_node = nodes.select("digest", "node").join(found, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    labelled = signed.select("doc_id", "n_shingles", "digest").join(per_node, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return labelled.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, rules: NearDedup = NearDedup()) -> DataFrame:
    """docs without the rows of near copies: the smallest doc_id of each component stays, once."""
    kept = near_dedup(docs.select("doc_id", "text"), rules).where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_lodestar_kept")).distinct()
    rest = docs.join(kept, docs["doc_id"] == kept["_lodestar_kept"], "left_semi").select(*docs.columns, F.col("doc_id").alias("_lodestar_kept"))
    first = rest.withColumn("_lodestar_place", F.row_number().over(Window.partitionBy("_lodestar_kept").orderBy("text"))).where("_lodestar_place = 1").select(*docs.columns)
    return first.unionByName(docs.where(F.col("doc_id").isNull()))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, three-word shingles, 85 percent."""
    return near_dedup(documents(spark, sf_dir), NearDedup(words=3, percent=85))


QUERIES = {"op9_near_dedup": op9_near_dedup}
#: All pairs of texts that share a shingle, without signatures.
ORACLE_SQL = {
    "op9_near_dedup": r"""WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
shingled AS (
  SELECT doc_id, CASE WHEN len(words) >= 3 THEN list_distinct(list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i:i + 2], ' '))) WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END AS shingles
  FROM split),
sized AS (SELECT doc_id, len(shingles) AS n FROM shingled),
members AS (SELECT doc_id, hash(unnest(shingles)) AS shingle FROM shingled),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM members a JOIN members b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT s.a, s.b FROM shared s JOIN sized x ON x.doc_id = s.a JOIN sized y ON y.doc_id = s.b WHERE 100 * s.n >= 85 * (x.n + y.n - s.n)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS component FROM documents UNION SELECT b.b, r.component FROM reach r JOIN edges b ON b.a = r.doc_id WHERE r.component < b.b),
least AS (SELECT doc_id, min(component) AS component_id FROM reach GROUP BY doc_id)
SELECT s.doc_id, s.n::BIGINT AS n_shingles, l.component_id, s.doc_id = l.component_id AS kept FROM sized s JOIN least l ON l.doc_id = s.doc_id""",
}
