"""Text reads: triage filters, titles, pages, domains, names and near-duplicates."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions import text as X
from lodestar.functions import urls
from lodestar.sources import tables as T
from lodestar.sources.shared import spread, stored

#: Phrases that occur in the driver's texts.
SAMPLE_PHRASES = ["licensed under", "all rights reserved", "released under"]


def preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that one of the default phrases, or of the samples, in their first 2000 characters rejects."""
    return T.read(spark, sf_dir, "documents").where(X.preflight_reject(F.col("text"), [*X.REJECTED, *SAMPLE_PHRASES])).select(F.col("doc_id").alias("id"))


def exclusion_hits(spark: SparkSession, sf_dir: str, terms: tuple[str, ...] = ("license", "stupid", "password")) -> DataFrame:
    """Items with an excluded term anywhere, and which."""
    hits = X.term_hits(F.col("text"), list(terms))
    return T.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), hits.alias("hits")).where(F.size("hits") > 0).select("id", F.concat_ws(",", "hits").alias("hits"))


def interest_hits(spark: SparkSession, sf_dir: str, topics: tuple[str, ...] = ("the", "licen")) -> DataFrame:
    """Items whose title has a topic."""
    title = T.first_line(F.col("text"))
    return T.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.size(X.term_hits(title, list(topics))).alias("n")).where("n > 0").select("id")


def title_from_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), T.first_line(F.col("text")).alias("title"))


def domains_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reading of every page's address."""
    u = F.col("url")
    return T.read(spark, sf_dir, "pages").select("page_id", urls.netloc(u).alias("netloc"), urls.domain(u).alias("domain"), urls.host(u).alias("host"), urls.briefing_source(u).alias("briefing"), urls.source_label(u).alias("label"), urls.favicon(u).alias("favicon"), urls.github_slug(u).alias("slug"))


def arxiv_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Abstract addresses (made from part keys) in one form, and how often each occurs."""
    k = F.col("p_partkey")
    raw = F.concat(F.when(k % 2 == 0, "http").otherwise("https"), F.lit("://arxiv.org/abs/2401."), F.lpad((k % 500).cast("string"), 5, "0"), F.when(k % 3 > 0, F.concat(F.lit("v"), (k % 3).cast("string"))).otherwise(""))
    return T.read(spark, sf_dir, "part").select(urls.arxiv_canonical(raw).alias("url")).groupBy("url").agg(F.count("*").alias("n"))


def entity_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.read(spark, sf_dir, "part").groupBy(T.entity_key(F.col("p_name")).alias("entity")).agg(F.count("*").alias("n"))


def clean_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles cleaned, every third with mark-up, entities and a type parameter around it, and every third with white space."""
    t = F.col("title")
    dressed = F.when(F.col("id") % 3 == 0, F.concat(F.lit('<p class="x">'), t, F.lit("</p> &amp;amp; Vec<T>"))).when(F.col("id") % 3 == 1, F.concat(F.lit(" \t"), t, F.lit("  "))).otherwise(t)
    return title_from_content(spark, sf_dir).select("id", X.clean_title(dressed).alias("title"))


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title and main text of every page."""
    return spread(T.read(spark, sf_dir, "pages")).select("page_id", X.read_page("html", "url").alias("p")).select("page_id", "p.*")


def canonical_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.read(spark, sf_dir, "part").select("p_name").distinct().select(X.canonical_name("p_name").alias("name")).groupBy("name").agg(F.count("*").alias("spellings"))


def simhash_docs(spark: SparkSession, sf_dir: str, md5: bool = False) -> DataFrame:
    """The SimHash of every document; over MD5 if the fixed hash isn't asked for."""
    return spread(T.read(spark, sf_dir, "documents")).select("doc_id", (X.simhash64_md5 if md5 else X.simhash64)("text").alias("simhash"))


def agreeing_masks(n: int, distance: int) -> list[int]:
    """Masks of which one at least covers none of the bits in which two 64-bit numbers differ, if those are distance at most. By the pigeonhole
    principle numbers cut into distance + k blocks agree in k of them; k is the least with which pairs of n random numbers that agree under a mask
    are no more than the rows, so that both grow with n."""
    for k in range(1, 64 - distance):
        edges = [64 * i // (distance + k) for i in range(distance + k + 1)]
        blocks = [(1 << hi) - (1 << lo) for lo, hi in zip(edges, edges[1:])]
        masks = [sum(some) for some in combinations(blocks, k)]
        if all(n >> m.bit_count() == 0 for m in masks):
            break
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def simhash_groups(spark: SparkSession, sf_dir: str, distance: int = 3, md5: bool = False) -> DataFrame:
    """Pairs a < b of distinct hashes within distance, each with its smallest document and number of documents.

    Hashes are made once and stored. Equal hashes are one row first, so copies aren't paired. An equi-join on what stands under each mask
    loses nothing (agreeing_masks), and a pair counts under the first mask under which it agrees.
    """
    hashes = stored(simhash_docs(spark, sf_dir, md5).groupBy("simhash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")), "simhashes")
    masks = agreeing_masks(hashes.count(), distance)
    rows = hashes.select("doc_id", "n", "simhash", F.posexplode(F.array(*[F.col("simhash").bitwiseAND(F.lit(m)) for m in masks])).alias("mask", "bits"))
    x, y = rows.alias("x"), rows.alias("y")
    differ = F.col("x.simhash").bitwiseXOR(F.col("y.simhash"))
    first = F.coalesce(*[F.when(differ.bitwiseAND(F.lit(m)) == 0, i) for i, m in enumerate(masks)])
    pairs = x.join(y, (F.col("x.mask") == F.col("y.mask")) & (F.col("x.bits") == F.col("y.bits")) & (F.col("x.doc_id") < F.col("y.doc_id")) & (F.bit_count(differ) <= distance) & (first == F.col("x.mask")))
    return pairs.select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b"), F.bit_count(differ).alias("distance"), F.col("x.n").alias("copies_a"), F.col("y.n").alias("copies_b"))


def exact_dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that occur twice or more: smallest document and count. Grouped by a digest, so that no text is shuffled."""
    return T.read(spark, sf_dir, "documents").groupBy(F.md5("text").alias("digest")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")


def entity_doc_freq(spark: SparkSession, sf_dir: str, ratio: float = 0.5, least_batch: int = 5) -> DataFrame:
    """Documents by capitalised word; words in more than a share of all documents are left out if there are enough."""
    docs = T.read(spark, sf_dir, "documents")
    words = docs.select("doc_id", F.explode(F.array_distinct(F.transform(F.split("text", "[ \n]"), lambda w: F.regexp_replace(w, "[.,!;:]+$", "")))).alias("word")).where(F.col("word").rlike("^[A-Z][a-z]+$"))
    n = docs.agg(F.count("*").alias("all"))
    return words.groupBy("word").agg(F.count("*").alias("docs")).crossJoin(F.broadcast(n)).where((F.col("all") < least_batch) | (F.col("docs") <= F.col("all") * ratio)).select("word", "docs")  # one row


def log_summary(lines: DataFrame, ok: str, failed: str, counters: dict[str, str] | None = None) -> DataFrame:
    """(line, value) lines of a log: the numbers of the last marker of success and of failure, whether success came last, and, if so, what the first
    line behind that fits each counter's pattern says in its group. Two aggregates; the log isn't sorted."""
    marked = lines.select("line", "value", F.col("value").rlike(ok).alias("ok"), F.col("value").rlike(failed).alias("failed"))
    last = marked.agg(F.max(F.when(F.col("ok"), F.col("line"))).alias("ok_line"), F.max(F.when(F.col("failed"), F.col("line"))).alias("failed_line"))
    last = last.withColumn("succeeded", F.col("ok_line").isNotNull() & (F.coalesce("failed_line", F.lit(-1)) < F.col("ok_line")))
    if not counters:
        return last
    behind = marked.crossJoin(F.broadcast(last)).where(F.col("succeeded") & (F.col("line") >= F.col("ok_line")))  # one row
    said = behind.agg(*[F.min_by(F.regexp_extract("value", p, 1), F.when(F.col("value").rlike(p), F.col("line"))).alias(name) for name, p in counters.items()])
    return last.crossJoin(said)


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary of a log with a line for each event."""
    i = F.col("event_id")
    value = F.when(i % 97 == 0, "run done").when(i % 89 == 0, "Traceback (most recent call last)").when(i % 10 == 3, F.concat(F.lit("saved: "), i.cast("string"))).otherwise("note")
    return log_summary(T.read(spark, sf_dir, "events").select(i.alias("line"), value.alias("value")), "^run done", "^Traceback", {"saved": r"^saved: (\d+)"})


def newest(files: DataFrame, keep: int) -> DataFrame:
    """(name) of all but the keep newest files: what pruning removes. The newest are a bounded page, so no order over all is made."""
    names = [r.name for r in files.orderBy(F.desc("name")).limit(keep).select("name").collect()]
    return files.where(~F.col("name").isin(names)) if names else files


def pruned_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What pruning to seven removes of a file for each part."""
    return newest(T.read(spark, sf_dir, "part").select(F.concat(F.lit("backup-"), F.lpad(F.col("p_partkey").cast("string"), 7, "0")).alias("name")), 7)
