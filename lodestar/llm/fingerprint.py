"""Document fingerprints by a homomorphic multiset hash; DataFrame operations only.

The fingerprint of a text is a vector that is the sum, modulo powers of two, of the vectors of its paragraphs, so it
doesn't depend on their order, and paragraphs are put in or taken out by ``plus`` and ``minus`` without the rest of
the text. A paragraph's vector has two parts:

* ``lanes``: LANES 60-bit hashes of the paragraph's SHA-256, summed modulo 2**60 (960 bits): equality of the multisets.
* ``sketch``: each block of the paragraph adds +1 or -1 to one of SLOTS * 3 counters (three counters of 20 bits share a 64-bit number).
  A block is a run of words that ends before a word with one of the letters of ``STARTS`` in front, or after MOST_WORDS words, so
  words put in or taken out change the blocks around them alone. Squared lengths of sketches and of their difference estimate
  those of the counts of blocks, so ``likeness`` estimates a.b / (a.a + b.b - a.b) of the two count vectors: Jaccard's index if
  no block repeats, 1 for equal counts, 0 for nothing shared. 66 counters leave a standard error of about 0.1.

The edited text of a document takes its end from the next document by falling doc_id (null last, equal doc_ids by a hash of the text; rows of
equal doc_id and text are one document here). The order is made over keys alone, in ranges that grow in number with the rows and split equal
doc_ids too; then one join by key brings each document the start of the next.

Null text counts as empty: one empty paragraph and no blocks. Two texts without blocks have likeness 1 if
their lanes are equal, else 0. Repeated rows have equal results. Texts are taken whole. An empty table gives no rows. Only doc_id and
text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.llm.common import documents, stored

LANES = 16
SLOTS = 22
MOST_WORDS = 16
#: Letters (Latin and Cyrillic) before which a block ends, about one word in five.
STARTS = "cmpsCMPSкмпсКМПС"
_MASK = (1 << 60) - 1
_COUNTER = 1 << 20
_GAP = r" \t\r\f\x0B"
BLOCK = rf"[^{_GAP}\n]+(?:[{_GAP}]+[^{_GAP}\n{STARTS}][^{_GAP}\n]*){{0,{MOST_WORDS - 1}}}"
#: Keys of a range that are put in order together: few where FEW_RANGES do, so that small tables are spread too.
RANGE_ROWS = 200_000
SMALL_RANGE_ROWS = 1000
FEW_RANGES = 1000


def _number(text: Column) -> Column:
    """The first 60 bits of the MD5 of a text."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with out: struct<lanes array<bigint>, sketch array<bigint>> of the text column."""
    # The intermediate arrays are columns read twice by the next step, so that no lambda evaluates them anew.
    digests, units = f"{out}_digests", f"{out}_units"
    hashes = F.transform(F.regexp_extract_all(text, F.lit(BLOCK), 0), _number)
    unit = F.transform(
        hashes,
        lambda h: F.struct(
            F.pmod(h, F.lit(SLOTS)).cast("int").alias("slot"),
            (F.when(F.shiftright(h, 40).bitwiseAND(1) == 1, F.lit(1).cast("long")).otherwise(F.lit(-1).cast("long"))
             * F.element_at(F.lit([1, _COUNTER, _COUNTER**2]).cast("array<bigint>"), (F.pmod(F.shiftright(h, 42), F.lit(3)) + 1).cast("int"))).alias("value"),
        ),
    )
    df = df.withColumn(digests, F.transform(F.split(text, "\n", -1), lambda p: F.sha2(p, 256))).withColumn(units, unit)
    zero = F.lit(0).cast("long")

    def lane(j: int) -> Column:
        return F.aggregate(digests, zero, lambda acc, d: (acc + _number(F.concat(F.lit(str(j)), d))).bitwiseAND(F.lit(_MASK)))

    slots = F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda j: F.aggregate(units, zero, lambda acc, u: acc + F.when(u["slot"] == j, u["value"]).otherwise(zero)))
    return df.withColumn(out, F.struct(F.array(*[lane(j) for j in range(LANES)]).alias("lanes"), slots.alias("sketch"))).drop(digests, units)


def plus(a: Column, b: Column, sign: int = 1) -> Column:
    """The fingerprint of the paragraphs of both; with sign -1, of those of a without those of b."""
    return F.struct(
        F.zip_with(a["lanes"], b["lanes"], lambda x, y: (x + sign * y).bitwiseAND(F.lit(_MASK))).alias("lanes"),
        F.zip_with(a["sketch"], b["sketch"], lambda x, y: x + sign * y).alias("sketch"),
    )


def minus(a: Column, b: Column) -> Column:
    return plus(a, b, -1)


def as_text(fp: Column) -> Column:
    """A fingerprint as text: lanes in hexadecimal, counters as numbers."""
    return F.concat(F.concat_ws("", F.transform(fp["lanes"], lambda x: F.lpad(F.hex(x), 15, "0"))), F.lit(":"), F.concat_ws(",", F.transform(fp["sketch"], lambda x: x.cast("string"))))


def _squares(packed: Column) -> Column:
    """Sum of the squares of the three counters of a number."""
    half = _COUNTER // 2

    def low(x: Column) -> Column:
        return (x + half).bitwiseAND(F.lit(_COUNTER - 1)) - half

    first = low(packed)
    second = low(F.shiftright(packed - first, 20))
    third = F.shiftright(F.shiftright(packed - first, 20) - second, 20)
    return first * first + second * second + third * third


def likeness(a: Column, b: Column) -> Column:
    """(S - D) / (S + D), at least 0: S adds up the squared lengths of both sketches, D is that of their difference."""

    def length(sketch: Column) -> Column:
        return F.aggregate(sketch, F.lit(0).cast("long"), lambda acc, x: acc + _squares(x)).cast("double")

    apart = length(F.zip_with(a["sketch"], b["sketch"], lambda x, y: x - y))
    both = length(a["sketch"]) + length(b["sketch"])
    return F.when(a["lanes"] == b["lanes"], F.lit(1.0)).when(both + apart == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), (both - apart) / (both + apart)))


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, d, t, text): the keys d and t of a document have no nulls; null text becomes empty."""
    df = docs.select("doc_id", F.coalesce("doc_id", F.lit(0)).cast("long").alias("d"), F.coalesce("text", F.lit("")).alias("text"))
    return df.withColumn("t", F.xxhash64("text", F.col("doc_id").isNull()))


# ---------------------------------------------------------------- neighbours by doc_id


def chain(ids: DataFrame) -> DataFrame:
    """(d, t, before_d, before_t, before_n) of each row of ids (doc_id, d, t, n_chars), which are distinct: the row before it, by falling doc_id.
    The last row is before the first."""
    rows = ids.count()
    ranges = max(1, rows // RANGE_ROWS, min(rows // SMALL_RANGE_ROWS, FEW_RANGES))
    order = [F.col("doc_id").desc_nulls_last(), F.col("t").asc()]
    dealt = stored(ids.repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id()), "fingerprint-order")
    row = F.struct("d", "t", "n_chars")
    # A row for each range, so one task and a broadcast do.
    ends = dealt.groupBy("range").agg(F.max(F.struct(F.col("doc_id").isNull().alias("none"), F.bitwise_not("d").alias("falling"), "t", "d", "n_chars")).alias("end"))
    ends = ends.select("range", F.struct("end.d", "end.t", "end.n_chars").alias("end"))
    by_range = Window.orderBy("range")
    of_all = F.last("end").over(by_range.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = ends.select("range", F.coalesce(F.lag("end").over(by_range), of_all).alias("end"))
    linked = dealt.withColumn("before", F.lag(row).over(Window.partitionBy("range").orderBy(*order))).join(F.broadcast(heads), "range")
    before = F.coalesce("before", "end")
    return linked.select("d", "t", before["d"].alias("before_d"), before["t"].alias("before_t"), before["n_chars"].alias("before_n"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. The
    edited text has its last third replaced by the start of the next document's."""
    own = keyed(docs)
    texts = own.drop("doc_id")
    printed = stored(with_fingerprint(own, "text", "fp").select("doc_id", "d", "t", F.char_length("text").alias("n_chars"), "fp"), "fingerprints")
    ids = printed.select("doc_id", "d", "t", "n_chars").distinct()
    links = stored(chain(ids), "fingerprint-chain")
    once = printed.groupBy("d", "t").agg(F.first("doc_id").alias("doc_id"), F.first("n_chars").alias("n_chars"), F.first("fp").alias("fp"))
    of_next = once.join(links, ["d", "t"]).select(F.col("before_d").alias("d"), F.col("before_t").alias("t"), F.col("fp").alias("next_fp"))
    known = once.join(of_next, ["d", "t"])
    # The one shuffle of the texts serves both joins; what a document needs of the next is a third of its own length at most.
    third = F.floor(F.col("before_n") / 3).cast("int")
    heads = texts.join(links.hint("shuffle_hash"), ["d", "t"]).select(F.col("before_d").alias("d"), F.col("before_t").alias("t"), F.left("text", third).alias("head"))
    if printed.count() > links.count():
        heads = heads.groupBy("d", "t").agg(F.first("head").alias("head"))
    df = texts.join(known.hint("shuffle_hash"), ["d", "t"]).join(heads.hint("shuffle_hash"), ["d", "t"])
    keep = F.col("n_chars") - F.floor(F.col("n_chars") / 3).cast("int")
    df = df.select("doc_id", "n_chars", "fp", "next_fp", F.concat(F.left("text", keep), "head").alias("edited"))
    df = with_fingerprint(df, "edited", "edited_fp")
    return df.select(
        "doc_id",
        F.col("n_chars").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("fp")).alias("fingerprint"),
        as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )


def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents and their edited texts."""
    return edited_fingerprints(documents(spark, sf_dir))


QUERIES = {"op8_fingerprint": op8_fingerprint}
ORACLE_SQL = {
    "op8_fingerprint": rf"""WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents),
pairs AS (
  SELECT doc_id, text, n, coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS next_id, coalesce(lead(text) OVER w, first_value(text) OVER w) AS next_text
  FROM texts WINDOW w AS (ORDER BY doc_id DESC)),
edits AS (SELECT doc_id, next_id, text, n, left(text, n - n // 3) || left(next_text, n // 3) AS edited FROM pairs),
every AS (SELECT doc_id, 0 AS kind, text FROM edits UNION ALL SELECT doc_id, 1, edited FROM edits),
digests AS (SELECT doc_id, kind, sha256(unnest(string_split(text, chr(10)))) AS digest FROM every),
lanes AS (
  SELECT doc_id, kind, j, (sum(('0x' || substr(md5(j || digest), 1, 15))::BIGINT) % {1 << 60})::BIGINT AS lane
  FROM digests, (SELECT unnest(range({LANES})) AS j) GROUP BY ALL),
lane_texts AS (SELECT doc_id, kind, string_agg(upper(lpad(to_hex(lane), 15, '0')), '' ORDER BY j) AS lanes FROM lanes GROUP BY ALL),
hashes AS (SELECT doc_id, kind, ('0x' || substr(md5(unnest(regexp_extract_all(text, '{BLOCK}'))), 1, 15))::BIGINT AS h FROM every),
counters AS (
  SELECT doc_id, kind, h % {SLOTS} AS slot, (h >> 42) % 3 AS field, sum(CASE WHEN (h >> 40) & 1 = 1 THEN 1 ELSE -1 END)::BIGINT AS c FROM hashes GROUP BY ALL),
packed AS (SELECT doc_id, kind, slot, sum(c * [1, {1 << 20}, {1 << 40}][field + 1]) AS v FROM counters GROUP BY ALL),
sketch_texts AS (
  SELECT e.doc_id, e.kind, string_agg(coalesce(p.v, 0)::BIGINT::VARCHAR, ',' ORDER BY s.slot) AS sketch
  FROM every e CROSS JOIN (SELECT unnest(range({SLOTS})) AS slot) s LEFT JOIN packed p ON p.doc_id = e.doc_id AND p.kind = e.kind AND p.slot = s.slot GROUP BY ALL),
prints AS (SELECT doc_id, kind, lanes, lanes || ':' || sketch AS print FROM lane_texts JOIN sketch_texts USING (doc_id, kind)),
sizes AS (SELECT doc_id, kind, sum(c * c) AS size FROM counters GROUP BY ALL),
wanted AS (SELECT doc_id, 1 AS what, doc_id AS other, 1 AS other_kind FROM edits UNION ALL SELECT doc_id, 0, next_id, 0 FROM edits),
dots AS (
  SELECT w.doc_id, w.what, sum(a.c * b.c) AS dot
  FROM wanted w JOIN counters a ON a.doc_id = w.doc_id AND a.kind = 0 JOIN counters b ON b.doc_id = w.other AND b.kind = w.other_kind AND b.slot = a.slot AND b.field = a.field GROUP BY ALL),
likes AS (
  SELECT w.doc_id, w.what, CASE WHEN p.lanes = q.lanes THEN 1.0::DOUBLE WHEN s + d = 0 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, (s - d)::DOUBLE / (s + d)::DOUBLE) END AS near
  FROM (SELECT w.*, coalesce(x.size, 0) + coalesce(y.size, 0) AS s, coalesce(x.size, 0) + coalesce(y.size, 0) - 2 * coalesce(dots.dot, 0) AS d
    FROM wanted w LEFT JOIN sizes x ON x.doc_id = w.doc_id AND x.kind = 0 LEFT JOIN sizes y ON y.doc_id = w.other AND y.kind = w.other_kind
    LEFT JOIN dots ON dots.doc_id = w.doc_id AND dots.what = w.what) w
  JOIN prints p ON p.doc_id = w.doc_id AND p.kind = 0 JOIN prints q ON q.doc_id = w.other AND q.kind = w.other_kind)
SELECT e.doc_id, e.n AS n_chars, sha256(e.edited) AS edited_sha256, o.print AS fingerprint, m.print AS edited_fingerprint, a.near AS near_edited, b.near AS near_next
FROM edits e JOIN prints o ON o.doc_id = e.doc_id AND o.kind = 0 JOIN prints m ON m.doc_id = e.doc_id AND m.kind = 1
JOIN likes a ON a.doc_id = e.doc_id AND a.what = 1 JOIN likes b ON b.doc_id = e.doc_id AND b.what = 0""",
}
