"""Line dedup by content-defined chunks of lines; DataFrame operations only.

A rolling hash runs over the hashes of each two neighbouring lines. A chunk is a longest run of lines that such hashes hold together which
stand at an earlier place too (lowest doc_id, then position): a chunk boundary falls where the rolling hash stops, or starts, to be a repeated
one, so that content alone chooses it and lines put in front don't move it. Chunks have two lines or more, as a rolling hash covers
two, and are removed from all places but the first if they hold ``min_chars`` characters. A line of over ``long_words`` words is a passage
of its own: it has a key of its own beside the rolling ones and goes alone where it stands earlier, whatever stands around it. A boundary rule that looks at the hash
alone (0 modulo a number) was tried first: whole chunks between such boundaries miss the ends of each repeated passage and
most passages of two to four lines, so it can't give whole results.

Hashes only nominate. The bytes of all lines that nominated hashes cover are compared, and if two lines share a hash the lines
themselves take the place of hashes. A rolling hash that stands in a share of 1 / ``heavy`` or more of all places is joined by broadcast (there
are ``heavy`` of these at most), so no task gets all places of a frequent passage.

Null texts have no lines and stay null; empty texts stay empty; a text whose lines all stand elsewhere first becomes empty. Of rows of
equal doc_id and text one is the first and the others repeat it. Single lines of ``long_words`` words at most that repeat between other lines stay. An empty table
gives no rows. All columns of docs are returned; working columns have a prefix of their own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import documents, stored

WORK = "_lodestar_line_dedup"


@dataclass(frozen=True)
class LineDedup:
    """min_chars: fewest characters of a chunk that is removed; long_words: most words of a line that isn't a chunk by itself; heavy: see the module."""

    min_chars: int = 40
    long_words: int = 50
    heavy: int = 2000


def _line_hash(line: Column) -> Column:
    return F.xxhash64(line)


def is_long(line: Column, words: int) -> Column:
    """Whether a line has more words than that; looks no further than these."""
    return line.rlike(rf"^[\x20\x09-\x0D]*+(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]++){{{words}}}[^\x20\x09-\x0D]")


def rolling(docs: DataFrame, line_key, rules: LineDedup = LineDedup()) -> DataFrame:
    """(d, t, pos, a, b): the rolling key of the lines pos and pos + 1 of each text, as the keys of both; and the key of
    each long line with that of a line's end, which no line holds, for b."""
    lines, keys = f"{WORK}_lines", f"{WORK}_keys"
    long = lambda line: is_long(line, rules.long_words)
    df = docs.select("doc_id", "text").where(F.col("text").contains("\n") | long(F.col("text"))).withColumn(lines, F.split("text", "\n", -1))
    df = df.withColumn(keys, F.transform(lines, line_key))
    pairs = F.zip_with(F.slice(keys, 1, F.size(keys) - 1), F.slice(keys, 2, F.size(keys) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    pairs = F.transform(pairs, lambda x, i: F.struct(i.alias("pos"), x["a"].alias("a"), x["b"].alias("b")))
    at = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: long(F.get(F.col(lines), i)))
    own = F.transform(at, lambda i: F.struct(i.alias("pos"), F.get(F.col(keys), i).alias("a"), line_key(F.lit("\n")).alias("b")))
    return df.select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("t"), F.inline(F.concat(pairs, own)))


def _with_repeats(docs: DataFrame, line_key, rules: LineDedup) -> DataFrame:
    """docs with WORK_named (first lines of rolling keys that stand in several places), WORK_gone (lines of those that stand
    earlier too, rising), WORK_copies (rows of this doc_id and text; null without repeated keys) and WORK_row."""
    places = stored(rolling(docs, line_key, rules), "line-places")
    counted = places.groupBy("a", "b").agg(F.count("*").alias("n"), F.min(F.struct("d", "t", "pos")).alias("first")).where("n > 1")
    repeated = stored(counted, "line-repeated")
    heavy = repeated.where(F.col("n") * rules.heavy >= places.count()).drop("n")
    light = places.join(F.broadcast(heavy.select("a", "b")), ["a", "b"], "left_anti").join(repeated.drop("n"), ["a", "b"])
    met = light.unionByName(places.join(F.broadcast(heavy), ["a", "b"]))
    # Of three equal lines the middle one belongs to the first place, which stays.
    inside = F.col("first") == F.struct("d", "t", (F.col("pos") - 1).alias("pos"))
    is_first = F.col("first") == F.struct("d", "t", "pos")
    own = F.col("b") == line_key(F.lit("\n"))
    gone = F.when(is_first, F.array().cast("array<int>")).when(own, F.array("pos")).when(inside, F.array(F.col("pos") + 1)).otherwise(F.array("pos", F.col("pos") + 1))
    # By the pair that opens a text, or the long line that is all of it.
    copies = F.greatest(F.count_if((F.col("pos") == 0) & ~F.col("own")), F.count_if((F.col("pos") == 0) & F.col("own")))
    # Sets, so that equal rows add nothing; a group holds no more than the lines of one text.
    named = (
        met.select("d", "t", "pos", gone.alias("gone"), own.alias("own"))
        .groupBy("d", "t")
        .agg(F.collect_set("pos").alias(f"{WORK}_named"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("gone")))).alias(f"{WORK}_gone"), copies.alias(f"{WORK}_copies"))
    )
    # The one shuffle of the texts.
    d, t = f"{WORK}_d", f"{WORK}_t"
    named = named.withColumnsRenamed({"d": d, "t": t})
    marked = docs.join(named.hint("shuffle_hash"), docs["doc_id"].eqNullSafe(named[d]) & (F.xxhash64(docs["text"]) == named[t]), "left").drop(d, t)
    return stored(marked.withColumn(f"{WORK}_row", F.monotonically_increasing_id()), "line-marked")


def _hashes_collide(marked: DataFrame) -> bool:
    """Whether two lines that repeated keys cover differ in bytes but not by hash."""
    df = marked.where(F.col(f"{WORK}_named").isNotNull()).select("text", f"{WORK}_named").withColumn(f"{WORK}_lines", F.split("text", "\n", -1))
    at = F.array_distinct(F.concat(f"{WORK}_named", F.transform(f"{WORK}_named", lambda i: i + 1)))
    covered = F.concat(F.transform(at, lambda i: F.get(F.col(f"{WORK}_lines"), i)), F.array(F.lit("\n")))
    lines = df.select(F.explode(covered).alias("line")).where("line IS NOT NULL")
    return not lines.select(_line_hash(F.col("line")).alias("h"), "line").distinct().groupBy("h").count().where("count > 1").isEmpty()


def line_dedup(docs: DataFrame, rules: LineDedup = LineDedup(), drop_emptied: bool = False) -> DataFrame:
    """docs with text without repeated chunks, and columns removed_chunks and removed_chars (existing
    ones of these names are replaced). With drop_emptied, rows go of which removal leaves spaces at most."""
    names = [c for c in docs.columns if c not in ("removed_chunks", "removed_chars")]
    docs = docs.select(*names)
    marked = _with_repeats(docs, _line_hash, rules)
    if _hashes_collide(marked):
        marked = _with_repeats(docs, lambda line: line, rules)

    gone, lines, edges, runs, row = (f"{WORK}_{x}" for x in ("gone", "lines", "edges", "runs", "row"))
    copies = F.coalesce(f"{WORK}_copies", F.lit(0))
    clean = marked.where((copies < 2) & (F.coalesce(F.size(gone), F.lit(0)) <= 0)).select(*names, F.lit(0).alias("removed_chunks"), F.lit(0).alias("removed_chars"))
    single = marked.where((copies < 2) & (F.size(gone) > 0)).drop(row)
    # All lines of the second of two equal rows stand earlier.
    several = marked.where(copies >= 2)
    firsts = several.groupBy("doc_id", "text").agg(F.min(row).alias(row)).select(row, F.lit(True).alias(f"{WORK}_is_first"))
    several = several.join(firsts, row, "left").withColumn(gone, F.when(F.col(f"{WORK}_is_first"), F.col(gone)).otherwise(F.sequence(F.lit(0), F.size(F.split("text", "\n", -1)) - 1)))
    short = single.unionByName(several.drop(row, f"{WORK}_is_first")).withColumn(lines, F.split("text", "\n", -1))
    starts = F.filter(gone, lambda x, i: (i == 0) | (F.get(F.col(gone), i - 1) != x - 1))
    ends = F.filter(gone, lambda x, i: (i == F.size(gone) - 1) | (F.get(F.col(gone), i + 1) != x + 1))
    short = short.withColumn(edges, F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("a"), b.alias("b"))))
    long_enough = lambda r: F.char_length(F.concat_ws("\n", F.slice(lines, r["a"] + 1, r["b"] - r["a"] + 1))) >= rules.min_chars
    short = short.withColumn(runs, F.filter(edges, long_enough))

    def piece(k: Column) -> Column:
        start = F.when(k == 0, 0).otherwise(F.get(F.col(runs), k - 1)["b"] + 1)
        end = F.when(k == F.size(runs), F.size(lines)).otherwise(F.get(F.col(runs), k)["a"])
        return F.slice(lines, start + 1, end - start)

    kept = F.concat_ws("\n", F.flatten(F.transform(F.sequence(F.lit(0), F.size(runs)), piece)))
    # A generator, as Catalyst would push a filter below the steps above and evaluate them anew for each line.
    left = F.array(kept) if not drop_emptied else F.filter(F.array(kept), lambda t: (F.size(runs) == 0) | (F.char_length(F.trim(t)) > 0))
    short = short.select(*short.columns, F.explode(left).alias(f"{WORK}_kept"))
    short = short.select(
        *[F.col(f"{WORK}_kept").alias("text") if c == "text" else F.col(c) for c in names],
        F.size(runs).alias("removed_chunks"),
        (F.char_length("text") - F.char_length(f"{WORK}_kept")).alias("removed_chars"),
    )
    return clean.unionByName(short)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with production limits."""
    return line_dedup(documents(spark, sf_dir).select("doc_id", "text"))


QUERIES = {"op4_line_dedup": op4_line_dedup}
#: The same without hashes. Rows of equal doc_id and text, which the driver's tables don't have, aren't told apart here.
ORACLE_SQL = {
    "op4_line_dedup": """WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL),
pairs AS (SELECT doc_id, pos, line AS a, lead(line) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM lines),
firsts AS (
  SELECT doc_id, pos, first_value(doc_id) OVER w AS first_doc, first_value(pos) OVER w AS first_pos
  FROM pairs WHERE b IS NOT NULL WINDOW w AS (PARTITION BY a, b ORDER BY doc_id, pos)),
gone AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN first_doc = doc_id AND first_pos = pos THEN []::BIGINT[] WHEN first_doc = doc_id AND first_pos = pos - 1 THEN [pos + 1] ELSE [pos, pos + 1] END) AS pos
  FROM firsts
  UNION SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) AS k FROM lines WHERE len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) > 50) WHERE k > 1),
marked AS (SELECT l.doc_id, l.pos, l.line, g.pos IS NOT NULL AS gone FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.pos = l.pos),
runs AS (SELECT *, CASE WHEN gone THEN pos - row_number() OVER (PARTITION BY doc_id, gone ORDER BY pos) END AS run FROM marked),
sized AS (SELECT *, CASE WHEN gone THEN sum(length(line) + 1) OVER (PARTITION BY doc_id, gone, run) - 1 ELSE 0 END AS chars FROM runs),
kept AS (
  SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE chars < 40), '') AS text, count(DISTINCT run) FILTER (WHERE chars >= 40) AS removed_chunks
  FROM sized GROUP BY doc_id)
SELECT d.doc_id, k.text, coalesce(k.removed_chunks, 0)::INTEGER AS removed_chunks, coalesce(length(d.text) - length(k.text), 0)::INTEGER AS removed_chars
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id""",
}
