"""Best-fit packing of documents into sequences of fixed length, after a dominance reduction.

Tokenisation runs in Arrow batches and its pieces (no texts) are stored. Packing needs only how
many pieces have each length: at most ``capacity`` numbers, however large the corpus. On that
histogram the driver first fixes Martello-Toth sets, sets of up to three pieces that provably
dominate every other set with the same largest piece, and shrinks the instance; the rest is packed
best-fit, longest first. Equal bins are handled together, so the work depends on the number of
distinct lengths, not on that of pieces. The layout is a table of rank ranges by length, whose size
is bounded by the lengths too; a piece finds its place by its rank among the pieces of its length.
Ranks are counts per (length, partition) summed over partitions plus a rank inside the partition,
so a length that a third of all pieces have is not gathered in one task.

Null text counts as empty: a piece with the end token alone. Texts longer than the capacity are cut
into full pieces and a last one. Repeated rows (and doc_ids) are packed row by row. An empty table
gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import json
import os
import unicodedata
import zlib
from array import array
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.llm.common import documents, map_batches, stored, worker_cache

CAPACITY = 4096
END_ID = 1
#: Distinct words whose ids a task remembers; beyond that it starts anew.
CACHED_WORDS = 600_000
#: Words that are encoded together, and groups of these at a time: what the tokeniser holds for them goes before the next.
GROUP_WORDS, GROUPS = 1000, 8
#: Bytes of text whose words a task splits at a time.
SPLIT_BYTES = 2 << 20
#: ASCII marks that the tokeniser takes as a token of their own behind letters.
MARKS = b"!\"#$%&()*+,-./:;=>?@[\\]^_`{|}~"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# ---------------------------------------------------------------- layout


@dataclass
class Bin:
    """count bins with the same contents: runs of (length, pieces per bin, offset in the bin)."""

    count: int
    used: int = 0
    runs: list = field(default_factory=list)

    def taking(self, count: int, length: int, pieces: int) -> Bin:
        return Bin(count, self.used + length * pieces, [*self.runs, (length, pieces, self.used)])


class Lengths:
    """A multiset of lengths with the searches that the reduction needs."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.n = np.zeros(capacity + 2, dtype=np.int64)
        for length, count in counts.items():
            self.n[length] = count

    def largest_up_to(self, limit: int) -> int:
        """The largest length present of at most limit, 0 if none."""
        at = np.flatnonzero(self.n[: max(0, limit) + 1])
        return int(at[-1]) if len(at) else 0

    def smallest(self, k: int) -> list[int]:
        """The k smallest pieces, fewer if there are fewer."""
        out: list[int] = []
        for at in np.flatnonzero(self.n)[:k]:
            out += [int(at)] * int(min(self.n[at], k - len(out)))
        return out[:k]


def dominating_set(lengths: Lengths, room: int) -> tuple[int, ...] | None:
    """What to put beside a piece that leaves room: pieces (none to two) such that any other choice
    could be exchanged for them without loss, or None if no such set is proven.

    Let k be the largest piece that fits. If k fills the room, every other choice fits into k's
    place. If no two pieces fit, any choice is one piece of at most k. If two but no three fit, any
    choice is a piece or a pair: k alone dominates if no pair is longer than k; the pair (k, b) with
    the largest b that fits beside k dominates if no pair has a smaller part above b.
    """
    k = lengths.largest_up_to(room)
    if not k:
        return ()
    low = lengths.smallest(3)
    if k == room or len(low) < 2 or low[0] + low[1] > room:
        return (k,)
    if len(low) == 3 and sum(low) <= room:
        return None
    lengths.n[k] -= 1
    b = lengths.largest_up_to(room - k)
    lengths.n[k] += 1
    half = lengths.largest_up_to(room // 2)
    if b and half <= b:
        return (k, b)
    best = max((int(x) + lengths.largest_up_to(room - int(x)) for x in np.flatnonzero(lengths.n[: room // 2 + 1])), default=0)
    return (k,) if best <= k else None


def reduce_instance(lengths: Lengths, capacity: int) -> list[Bin]:
    """Takes dominating sets out of lengths, longest piece first, and returns their bins."""
    fixed = []
    for length in range(capacity, 0, -1):
        while lengths.n[length]:
            lengths.n[length] -= 1
            beside = dominating_set(lengths, capacity - length)
            lengths.n[length] += 1
            if beside is None:
                break
            need: dict[int, int] = defaultdict(int)
            for x in (length, *beside):
                need[x] += 1
            # Every proof above stays valid while pieces of these lengths are left: what is left
            # only gets fewer. So equal sets are fixed at once.
            times = int(min(lengths.n[x] // k for x, k in need.items()))
            made = Bin(times)
            for x, k in sorted(need.items(), reverse=True):
                made = made.taking(times, x, k)
                lengths.n[x] -= k * times
            fixed.append(made)
    return fixed


def best_fit(lengths: Lengths, capacity: int) -> list[Bin]:
    """Best-fit decreasing with equal bins taken together."""
    by_room: dict[int, list[Bin]] = defaultdict(list)
    rooms = np.zeros(capacity + 1, dtype=bool)
    for length in range(capacity, 0, -1):
        left = int(lengths.n[length])
        while left:
            open_at = np.flatnonzero(rooms[length:])
            if len(open_at):
                room = length + int(open_at[0])
                old = by_room[room].pop()
                rooms[room] = bool(by_room[room])
            else:
                room, old = capacity, Bin(left)
            each = min(room // length, left)  # a bin that took one is the tightest for the next
            full = min(old.count, left // each)
            new = old.taking(full, length, each)
            by_room[capacity - new.used].append(new)
            rooms[capacity - new.used] = True
            if old.count > full and old.runs:
                by_room[room].append(Bin(old.count - full, old.used, old.runs))
                rooms[room] = True
            left -= full * each
    return [b for at in by_room.values() for b in at]


def layout(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, last rank + 1, first sequence, pieces per sequence, offset)."""
    lengths = Lengths(counts, capacity)
    rows, at, sequence = [], defaultdict(int), 0
    for made in [*reduce_instance(lengths, capacity), *best_fit(lengths, capacity)]:
        for length, pieces, offset in made.runs:
            rows.append((length, at[length], at[length] + made.count * pieces, sequence, pieces, offset))
            at[length] += made.count * pieces
        sequence += made.count
    return rows


# ---------------------------------------------------------------- Spark


def _plain_letters(text: str) -> bool:
    """Whether the tokeniser, which composes and lower-cases a text first, is left with letters alone; only
    for scripts whose letters no version of Unicode disputes."""
    text = unicodedata.normalize("NFC", text).lower()
    return text.isalpha() and max(text) < "\u0530"


class WordIds:
    """Token ids of words between ASCII white space, as little-endian bytes.

    No token of this tokeniser spans white space, so a text's ids are those of its words. Words of
    letters alone are encoded many at a time: each then ends in exactly one end-of-word token.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has the cores dealt out already
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        # For words of letters alone the same model without the pattern that parts letters from marks.
        plain = json.loads(self.model.to_str())
        plain["pre_tokenizer"]["pretokenizers"][0] = {"type": "WhitespaceSplit"}
        self.letters = Tokenizer.from_str(json.dumps(plain))
        vocabulary = self.model.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}
        self.tails = {b"": b""}

    def encode(self, word: bytes) -> bytes:
        return array("I", self.model.encode(word.decode(), add_special_tokens=False).ids).tobytes()

    def encode_letters(self, words: list[bytes]) -> None:
        groups = [words[lo : lo + GROUP_WORDS] for lo in range(0, len(words), GROUP_WORDS)]
        for lo in range(0, len(groups), GROUPS):
            self._encode_groups(groups[lo : lo + GROUPS])

    def _encode_groups(self, groups: list[list[bytes]]) -> None:
        for group, got in zip(groups, self.letters.encode_batch_fast([b" ".join(g).decode() for g in groups], add_special_tokens=False)):
            ids = np.array(got.ids, dtype="<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(group):  # these are not what the tokeniser takes for letters
                self.known.update((w, self.encode(w)) for w in group)
                continue
            data, at = ids.tobytes(), (4 * cuts).tolist()
            self.known.update((w, data[lo:hi]) for w, lo, hi in zip(group, [0, *at], at))

    def learn(self, words: set[bytes]) -> None:
        """Makes self.known hold all of words. A word of letters with marks behind is its letters' ids and the
        marks' ids, as the tokeniser parts letters from marks; apostrophes and ``<`` may be more than marks."""
        if len(self.known) + len(words) > CACHED_WORDS:
            self.known.clear()
        known = self.known
        marked = []
        letters = set()
        for word in words - known.keys():
            stem = word.rstrip(MARKS)
            if not (stem.isalpha() or _plain_letters(stem.decode())):
                known[word] = self.encode(word)
                continue
            letters.add(stem)
            if len(stem) < len(word):
                marked.append((word, stem, word[len(stem) :]))
        self.encode_letters(list(letters - known.keys()))
        for word, stem, tail in marked:
            if tail not in self.tails:
                self.tails[tail] = self.encode(tail)
            known[word] = known[stem] + self.tails[tail]
        if len(self.tails) > CACHED_WORDS:
            self.tails = {b"": b""}


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """Each document's pieces: row (a number of its row), doc_id, piece, start, length, ids_crc32, part
    and rank (the piece's place among those of its length in its partition), and ids if asked for."""
    path = tokenizer or default_tokenizer()

    def work(chunks):
        cache = worker_cache()
        if cache.get("packing", (None,))[0] != path:
            cache["packing"] = (path, WordIds(path))
        model = cache["packing"][1]
        part = TaskContext.get().partitionId()
        ranks: dict[int, int] = defaultdict(int)
        end, row = array("I", [END_ID]).tobytes(), part << 33
        size = 4 * capacity
        for chunk in chunks:
            # The tokeniser lower-cases; doing so here lets more words meet. Its special tokens are
            # matched as they stand, so a text with one's opening is left alone.
            texts = [(t.lower() if b"<|" not in t else t).split() if t else [] for t in chunk["text"]]
            model.learn(set().union(*texts))
            look_up = model.known.__getitem__
            out: dict[str, list] = {k: [] for k in ("row", "doc_id", "piece", "start", "length", "ids_crc32", "part", "rank", "ids")}
            for doc_id, words in zip(chunk["doc_id"], texts):
                ids = b"".join([*map(look_up, words), end])
                for piece, lo in enumerate(range(0, len(ids), size)):
                    own = ids[lo : lo + size]
                    n = len(own) // 4
                    for k, v in (("row", row), ("doc_id", doc_id), ("piece", piece), ("start", lo // 4), ("length", n), ("ids_crc32", zlib.crc32(own)), ("part", part), ("rank", ranks[n])):
                        out[k].append(v)
                    if with_ids:
                        out["ids"].append(np.frombuffer(own, dtype="<u4").astype(np.int32))
                    ranks[n] += 1
                row += 1
            yield out
        model.known.clear()  # an idle worker holds nothing

    schema = "row long, doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long" + ", ids array<int>" * with_ids
    return map_batches(docs, ["doc_id", "text"], schema, work, SPLIT_BYTES)


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """The pieces with sequence_id and offset."""
    # Stored once: a second run of the tokeniser could deal other ranks after a lost executor.
    pieces = stored(token_pieces(docs, capacity, tokenizer, with_ids), "pieces")
    per_part = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_part.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    counts = {r.length: r.n for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    rows = layout(counts, capacity)
    by_length: dict[int, list] = defaultdict(list)
    for row in rows:
        by_length[row[0]].append(row)
    ranges = {length: np.array(rs, dtype=np.int64) for length, rs in by_length.items()}

    def place(batches):
        import pyarrow as pa

        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy() + batch.column("first").to_numpy()
            sequence, offset = np.empty((2, len(length)), dtype=np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order], prepend=-1))
            for lo, hi in zip(cuts, [*cuts[1:], len(order)]):
                at = order[lo:hi]
                table = ranges[int(length[at[0]])]
                r = table[np.searchsorted(table[:, 1], rank[at], side="right") - 1]
                inside = rank[at] - r[:, 1]
                sequence[at] = r[:, 3] + inside // r[:, 4]
                offset[at] = r[:, 5] + inside % r[:, 4] * r[:, 0]
            kept = [c for name, c in zip(batch.schema.names, batch.columns) if name != "first"]
            names = [name for name in batch.schema.names if name != "first"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    columns = pieces.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id bigint, offset bigint"
    placed = pieces.join(starts, ["length", "part"]).select(*columns, "first").mapInArrow(place, schema)
    return placed.drop("row", "part", "rank")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096 tokens."""
    return pack(documents(spark, sf_dir))


QUERIES = {"op2_best_fit_packing": op2_best_fit_packing}
