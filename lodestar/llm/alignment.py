"""Cross-tokenizer alignment: which tokens of two tokenizers end together, in each text and over the corpus.

Tokenizer A is byte-level BPE over a space and the text, B a SentencePiece model over the text (it adds the space). Byte
offsets where a token of both ends cut the tokens into groups; the two tokens that end at such an offset are linked. An id
pair's count is the number of its links in the corpus.

Both tokenizers cut before a space behind something else, so a text falls into units (a space and what follows) whose tokens don't depend on their
neighbours. New units are encoded many at a time, and their groups and links remembered.

The corpus part is a postings cogroup. Documents' pair multiplicities are stored as postings of B's ids. Counts of pairs are
pre-aggregated in each task and summed; one row per B id holds its partners' counts and the highest. These rows and the postings are dealt by B id and sorted
by Spark (which spills), each id's counts before its postings, so that a task reads them as one stream: it holds one id's counts (one for each
id of A at most) and a batch of postings, and emits what each document gains, summed as it goes, in blocks of documents. These blocks are dealt once more and summed per document. An id with
many postings is dealt over several tasks; its counts go to all of them.

A text that is null or empty, or whose tokens of A or B don't join to the bytes of space and text (for instance one with U+2581, which B takes for a space), has
no tokens: all figures are 0 and its digest is empty. Repeated rows (and ids) count row by row. An empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import os
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import Sums, documents, map_batches, stored, summed, worker_cache

#: Pairs are held as b * PAIR + a; A has fewer ids than that.
PAIR = 1 << 16
#: Units that a worker remembers, and their characters; beyond that it starts anew.
UNITS, UNIT_CHARS = 500_000, 8_000_000
#: Characters of units that are encoded as one text, and such texts at a time.
GROUP_CHARS, GROUPS = 16_000, 8
#: Postings and counts that a task holds before it sums them.
HELD = 2_000_000
#: Bytes of text that become one block of postings.
BLOCK_BYTES = 4 << 20


@dataclass(frozen=True)
class Alignment:
    """a, b: files of the tokenizers (none: the public ones); salt_rows: postings of a B id that one task takes; a quarter of
    what a shuffle partition gets of all, if that is more."""

    a: str | None = None
    b: str | None = None
    salt_rows: int = 20_000

    @property
    def paths(self) -> tuple[str, str]:
        import public_tokenizers

        return self.a or public_tokenizers.path("byte_bpe_50k.json"), self.b or public_tokenizers.path("piece_bpe_32k.model")


def byte_letters() -> dict[str, int]:
    """The printable characters that stand for bytes in entries of byte-level BPE, by the published rule."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def units(text: str) -> list[str]:
    """The units of a space and text. A space behind white space, or at the end, cuts nothing off."""
    found = text.split(" ")
    if "" not in found and not any(p[-1].isspace() for p in found):
        return [" " + p for p in found]
    out: list[str] = []
    opened = True
    for p in found:
        if opened:
            out.append(" " + p)
        else:
            out[-1] += " " + p
        opened = bool(p) and not p[-1].isspace()
    if len(out) > 1 and not out[-1].strip(" "):
        last = out.pop()
        out[-1] += last
    return out


class Aligner:
    """Both tokenizers, and the units they have met, numbered: the arrays hold each one's figures, texts its groups (each closed by ``;``),
    and links the pairs (b * PAIR + a) of all, n_groups from first_link on."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has the cores dealt out already
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        letters = byte_letters()
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.bytes_a[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i in range(self.b.get_piece_size()) for p in [self.b.id_to_piece(i)]]
        self.size_a, self.size_b = (np.array([len(x) for x in own], dtype=np.int64) for own in (self.bytes_a, self.bytes_b))
        ids = range(max(len(self.bytes_a), len(self.bytes_b)))
        self.said = {mark: np.array([f"{i}{mark}" for i in ids], dtype=object) for mark in ",|;"}
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.texts: list[str] = []
        self.chars = 0
        self.n_a = self.n_b = self.n_groups = self.first_link = np.zeros(0, dtype=np.int64)
        self.ok, self.links = np.zeros(0, dtype=bool), np.zeros(0, dtype=np.int32)

    def learn(self, wanted: set[str]) -> None:
        """Makes the units of wanted known; those met before may go."""
        if len(self.number) + len(wanted) > UNITS or self.chars > UNIT_CHARS:
            self.clear()
        groups: list[list[str]] = []
        room = 0
        for u in wanted - self.number.keys():
            # Others, which hold further spaces or end in white space, could meet the next unit.
            plain = u.find(" ", 1) < 0 and len(u) > 1 and not u[-1].isspace()
            if not plain or room < len(u):
                groups.append([])
                room = GROUP_CHARS if plain else 0
            groups[-1].append(u)
            room -= len(u)
        got = []
        for lo in range(0, len(groups), GROUPS):
            texts = ["".join(g) for g in groups[lo : lo + GROUPS]]
            ids_a = [x.ids for x in self.a.encode_batch_fast(texts, add_special_tokens=False)]
            for own in zip(groups[lo : lo + GROUPS], texts, ids_a, self.b.encode([t[1:] for t in texts], num_threads=1)):
                got += self._cut(*own)
        n_a, n_b, n_groups, links, ok = (np.concatenate(x) for x in zip(*got)) if got else (np.zeros(0, dtype=np.int64),) * 5
        self.first_link = np.concatenate([self.first_link, len(self.links) + np.cumsum(n_groups) - n_groups])
        self.n_a, self.n_b, self.n_groups = np.concatenate([self.n_a, n_a]), np.concatenate([self.n_b, n_b]), np.concatenate([self.n_groups, n_groups])
        self.links, self.ok = np.concatenate([self.links, links.astype(np.int32)]), np.concatenate([self.ok, ok.astype(bool)])

    def _cut(self, group: list[str], text: str, a: list[int], b: list[int]):
        """Numbers the units of group, whose joined text has the tokens a and b; yields their figures. Where the tokens don't join to the text, or not at the
        ends of units, each unit is encoded alone."""
        ends = np.cumsum([len(u.encode()) for u in group])
        a, b = np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        data = text.encode()
        fits = b"".join([self.bytes_a[i] for i in a]) == data == b"".join([self.bytes_b[i] for i in b])
        if len(group) > 1 and not (fits and np.isin(ends, ends_a).all() and np.isin(ends, ends_b).all()):
            for u in group:
                yield from self._cut([u], u, self.a.encode(u, add_special_tokens=False).ids, self.b.encode(u[1:], num_threads=1))
            return
        for u in group:
            self.number[u] = len(self.number)
        self.chars += len(text)
        if not fits:
            self.texts.append("")
            yield np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.int32), np.zeros(1, dtype=bool)
            return
        last_a, last_b = np.isin(ends_a, ends_b), np.isin(ends_b, ends_a)  # of their groups
        cut_a, cut_b = np.flatnonzero(last_a), np.flatnonzero(last_b)
        of = lambda at: np.bincount(np.searchsorted(ends, at), minlength=len(group))
        n_a, n_b = of(ends_a), of(ends_b)
        # A token of a follows all of b in earlier groups, one of b all of a up to its own.
        said = np.empty(len(a) + len(b), dtype=object)
        said[np.arange(len(a)) + np.append(0, cut_b + 1)[np.cumsum(last_a) - last_a]] = np.where(last_a, self.said["|"][a], self.said[","][a])
        said[np.arange(len(b)) + (cut_a + 1)[np.cumsum(last_b) - last_b]] = np.where(last_b, self.said[";"][b], self.said[","][b])
        parts, at = said.tolist(), np.append(0, np.cumsum(n_a + n_b)).tolist()
        self.texts += ["".join(parts[lo:hi]) for lo, hi in zip(at[:-1], at[1:])]
        yield n_a, n_b, of(ends_a[cut_a]), (b[cut_b] * PAIR + a[cut_a]).astype(np.int32), np.ones(len(group), dtype=bool)


def aligner(paths: tuple[str, str]) -> Aligner:
    cache = worker_cache()
    if cache.get("alignment", (None,))[0] != paths:
        cache["alignment"] = (paths, Aligner(*paths))
    return cache["alignment"][1]


def _lists(values: np.ndarray, offsets: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.astype(kind)))


#: Rows of documents (row and doc_id to groups_sha256); postings of a B id in a block of documents (b, block, a, doc, n: the row is block + doc); counts of a B id's pairs (b, a, n).
ALIGNED = "kind int, row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, b int, block long, a array<int>, doc array<int>, n array<int>"
DOCUMENT, POSTINGS, COUNTS = 0, 1, 2


def aligned(docs: DataFrame, rules: Alignment = Alignment()) -> DataFrame:
    """All that one pass over the texts gives: see ALIGNED."""
    paths = rules.paths
    names = [x.split()[0] for x in ALIGNED.split(", ")]

    def rows_of(kind, size, **given):
        return {name: given.get(name, [kind] * size if name == "kind" else [None] * size) for name in names}

    def by_b(keys):
        """B ids of sorted keys, and where each one's part begins and the last ends."""
        b = keys // PAIR
        first = np.flatnonzero(np.diff(b, prepend=-1))
        return b[first].astype(np.int32), np.append(first, len(keys))

    def work(chunks):
        both = aligner(paths)
        row = TaskContext.get().partitionId() << 33
        counts = Sums(1)
        for chunk in chunks:
            split = [units(t.decode()) if t else [] for t in chunk["text"]]
            both.learn(set().union(*split))
            size = len(split)
            own = np.array([both.number[u] for of in split for u in of], dtype=np.int64)
            doc = np.repeat(np.arange(size), [len(x) for x in split])
            bad = np.bincount(doc, weights=~both.ok[own], minlength=size) > 0
            own, doc = own[~bad[doc]], doc[~bad[doc]]
            figure = lambda of: np.bincount(doc, weights=of[own], minlength=size).astype(np.int64)  # noqa: B023, E731
            n_groups = figure(both.n_groups)
            at = np.searchsorted(doc, np.arange(size + 1)).tolist()
            texts = [both.texts[i] for i in own.tolist()]
            said = ["".join(texts[lo:hi]) for lo, hi in zip(at[:-1], at[1:])]
            yield rows_of(
                DOCUMENT, size, row=np.arange(row, row + size), doc_id=chunk["doc_id"], n_a=figure(both.n_a), n_b=figure(both.n_b), n_groups=n_groups, n_links=n_groups,
                groups_sha256=[hashlib.sha256(t[:-1].encode()).hexdigest() if t else "" for t in said],
            )
            # Each group ends in a link. (b, a, document) to the number of links, sorted.
            reps = both.n_groups[own]
            keys = both.links[np.repeat(both.first_link[own] - np.cumsum(reps) + reps, reps) + np.arange(reps.sum())].astype(np.int64)
            held, n = np.unique(keys * size + np.repeat(doc, reps), return_counts=True)
            keys, doc = held // size, held % size
            b, offsets = by_b(keys)
            yield rows_of(POSTINGS, len(b), b=b, block=np.full(len(b), row), a=_lists(keys % PAIR, offsets, np.int32), doc=_lists(doc, offsets, np.int32), n=_lists(n, offsets, np.int32))
            counts.add(*summed(keys, n))
            if counts.held > HELD:
                counts.add(*counts.taken())
                if counts.held > HELD // 2:
                    yield counted(counts)
            row += size
        yield counted(counts)

    def counted(counts):
        keys, n = counts.taken()
        b, offsets = by_b(keys)
        return rows_of(COUNTS, len(b), b=b, a=_lists(keys % PAIR, offsets, np.int32), n=_lists(n, offsets, np.int32))

    return map_batches(docs, ["doc_id", "text"], ALIGNED, work, BLOCK_BYTES)


def pair_counts(found: DataFrame) -> DataFrame:
    """(a, b, n_links): how many links of the corpus hold each pair, of what aligned() gave."""
    pairs = found.where(F.col("kind") == COUNTS).select("b", F.explode(F.arrays_zip("a", "n")).alias("pair"))
    return pairs.groupBy("b", F.col("pair.a").alias("a")).agg(F.sum("pair.n").alias("n_links"))


def _gains(batches):
    """What documents gain, of a stream that has each B id's counts before its postings: a row for each block, as arrays."""
    sums, blocks = Sums(2), set()

    def out():
        row, best, total = sums.taken()
        starts = np.array(sorted(blocks), dtype=np.int64)
        blocks.clear()
        offsets = np.append(np.searchsorted(row, starts), len(row))
        doc = row - np.repeat(starts, np.diff(offsets))
        return pa.RecordBatch.from_arrays([pa.array(starts), _lists(doc, offsets, np.int32), _lists(best, offsets, np.int64), _lists(total, offsets, np.int64)], names=["block", "doc", "n_best", "count_sum"])

    now, ids, counts, most = None, None, None, 0
    for batch in batches:
        b, kind, block = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("b", "kind", "block"))
        lists = {k: batch.column(k) for k in ("a", "n", "doc", "total")}
        offsets = {k: v.offsets.to_numpy() for k, v in lists.items()}
        values = {k: v.values.to_numpy() for k, v in lists.items()}
        for i in range(batch.num_rows):
            at = lambda k: values[k][offsets[k][i] : offsets[k][i + 1]]  # noqa: B023, E731
            if kind[i] == COUNTS:
                ids, counts = at("a"), at("total")
                order = np.argsort(ids)
                now, ids, counts = b[i], ids[order], counts[order]
                most = counts.max()
                continue
            assert b[i] == now, "postings without their counts"
            count, n = counts[np.searchsorted(ids, at("a"))], at("n").astype(np.int64)
            sums.add(int(block[i]) + at("doc").astype(np.int64), n * (count == most), n * count)
            blocks.add(int(block[i]))
            if sums.held > HELD:
                yield out()
    if blocks:
        yield out()


def _gained(batches):
    """The sums per document, of rows of _gains sorted by block."""
    now, parts = None, []

    def out():
        doc, best, total = summed(*(np.concatenate([p[k] for p in parts]) for k in range(3)))
        return pa.RecordBatch.from_arrays([pa.array(now + doc.astype(np.int64)), pa.array(best), pa.array(total)], names=["row", "n_best", "count_sum"])

    for batch in batches:
        block = batch.column("block").to_numpy()
        lists = [batch.column(k) for k in ("doc", "n_best", "count_sum")]
        for i in range(batch.num_rows):
            if block[i] != now:
                if parts:
                    yield out()
                now, parts = int(block[i]), []
            parts.append([x[i].values.to_numpy() for x in lists])
            if len(parts) > 200:
                parts = [summed(*(np.concatenate([p[k] for p in parts]) for k in range(3)))]
    if parts:
        yield out()


def corpus_gains(found: DataFrame, rules: Alignment = Alignment()) -> DataFrame:
    """(row, n_best, count_sum) of each document with links: the postings cogroup."""
    spark = found.sparkSession
    per_b = pair_counts(found).groupBy("b").agg(F.collect_list("a").alias("a"), F.collect_list("n_links").alias("total"))
    posted = found.where(F.col("kind") == POSTINGS)
    postings = posted.agg(F.sum(F.size("a"))).first()[0] or 0
    of_a_salt = max(rules.salt_rows, postings // (4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    # One row for each id of B at most: a bounded broadcast.
    salts = F.broadcast(posted.groupBy("b").agg(F.ceil(F.sum(F.size("a")) / of_a_salt).cast("int").alias("salts")))
    none = lambda t: F.array().cast(f"array<{t}>")
    heads = per_b.join(salts, "b").select("b", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(COUNTS).alias("kind"), F.lit(0).cast("long").alias("block"), "a", none("int").alias("n"), none("int").alias("doc"), "total")
    dealt = posted.join(salts, "b").select("b", F.pmod(F.xxhash64("block"), "salts").cast("int").alias("salt"), "kind", "block", "a", "n", "doc", none("long").alias("total"))
    # Counts (2) before postings (1).
    stream = heads.unionByName(dealt).repartition("b", "salt").sortWithinPartitions("b", "salt", F.desc("kind"))
    gains = stream.mapInArrow(_gains, "block long, doc array<int>, n_best array<bigint>, count_sum array<bigint>")
    return gains.repartition("block").sortWithinPartitions("block").mapInArrow(_gained, "row long, n_best long, count_sum long")


def align(docs: DataFrame, rules: Alignment = Alignment()) -> DataFrame:
    """Per row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256."""
    found = stored(aligned(docs, rules), "aligned")
    own = found.where(F.col("kind") == DOCUMENT).select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    gained = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return own.join(corpus_gains(found, rules), "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", gained("n_best"), gained("count_sum"), "groups_sha256")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents under the two public tokenizers."""
    return align(documents(spark, sf_dir))


QUERIES = {"op13_alignment": op13_alignment}
