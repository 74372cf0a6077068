"""Staging, idempotent writes as next-state tables, state transitions, validated event batches, tombstones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions import text as X
from lodestar.functions import urls
from lodestar.sources import tables as T
from lodestar.sources.tables import AS_OF

HOPS = 8


def first_seen(df: DataFrame, key: str, ordinal: str) -> DataFrame:
    """The first row of each key in order of ordinal."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(ordinal))).where("_n = 1").drop("_n")


def latest(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The row of each key that comes first in order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def insert_missing(target: DataFrame, batch: DataFrame, key: str, ordinal: str) -> DataFrame:
    """INSERT ... ON CONFLICT DO NOTHING: the rows of batch to append."""
    return first_seen(batch, key, ordinal).join(target.select(key), key, "left_anti")


def dedup_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of a crawl (lineitem rows stand for hits: many repeat) that neither items nor the queue have, first hit first."""
    hits = T.read(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.min(F.struct("l_orderkey", "l_linenumber")).alias("m"))
    crawl = hits.select(F.concat(F.lit("https://src"), (F.col("l_partkey") % 20).cast("string"), F.lit(".example.com/d/"), F.col("l_partkey").cast("string")).alias("source_url"), F.col("m.l_orderkey").alias("first_order"))
    known = T.items(spark, sf_dir, "source_url").union(T.crawl_queue(spark, sf_dir).select("source_url"))
    return crawl.join(known, "source_url", "left_anti")


def queue_batch(spark: SparkSession, sf_dir: str, limit: int = 150) -> DataFrame:
    """What is popped next: newest published first, then oldest queued; limit 0 takes all."""
    df = T.crawl_queue(spark, sf_dir).orderBy(F.col("published_s").desc_nulls_last(), "queued_s", "queue_id")
    return (df.limit(limit) if limit else df).select("queue_id", "source_url", "published_s", "queued_s")


def queue_retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queue rows that stay: valid but not saved, or failed in triage (outcomes are made from the ids)."""
    i = F.col("queue_id")
    q = T.crawl_queue(spark, sf_dir).withColumns({"valid": i % 3 != 0, "saved": i % 2 == 0, "triage_error": i % 11 == 0})
    return q.where((F.col("valid") & ~F.col("saved")) | F.col("triage_error")).select("queue_id", "valid", "saved", "triage_error")


def without(queue: DataFrame, done: DataFrame, key: str = "source_url") -> DataFrame:
    """DELETE ... WHERE key IN (...): the queue without the rows of done."""
    return queue.join(done.select(key).distinct(), key, "left_anti").select(*queue.columns)


def stamped(table: DataFrame, ids: DataFrame, key: str, column: str, at_s: int) -> DataFrame:
    """UPDATE ... SET column = at_s WHERE key IN (...): the next state of table."""
    hit = ids.select(F.col(key)).distinct().withColumn("_hit", F.lit(True))
    new = F.when(F.col("_hit"), F.lit(at_s)).otherwise(F.col(column)).alias(column)
    return table.join(hit, key, "left").select(*[new if c == column else F.col(c) for c in table.columns])


def briefed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with the time of their briefing: now for those of this one's pool, else what was there (every seventh has one)."""
    from lodestar.operators import ranking

    table = T.items(spark, sf_dir, "id").withColumn("briefed_s", F.when(F.col("id") % 7 == 0, F.lit(AS_OF - 86400)))
    return stamped(table, ranking.briefing_pool(spark, sf_dir), "id", "briefed_s", AS_OF)


def toggled(assets: DataFrame, presses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What presses of a card's button (tech_id, target, active) do to assets (tech_id, status): a set one clears the decision if it is still
    the target, and leaves any other alone; an unset one makes or switches the asset. (outcomes, next assets.)"""
    df = assets.join(presses, "tech_id", "full")
    clears = F.coalesce(F.col("active"), F.lit(False))
    gone = clears & (F.col("status") == F.col("target"))
    outcomes = df.where(F.col("target").isNotNull()).select("tech_id", F.when(clears, "REMOVED").otherwise("SET").alias("outcome"), F.coalesce(gone, F.lit(False)).alias("deletes"))
    after = F.when(clears | F.col("target").isNull(), F.col("status")).otherwise(F.col("target"))
    return outcomes, df.where(~F.coalesce(gone, F.lit(False))).select("tech_id", after.alias("status")).where("status IS NOT NULL")


def asset_toggles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every asset after a press on each third item's Keep button, shown as set by id."""
    i = F.col("doc_id")
    presses = T.read(spark, sf_dir, "documents").select(i.alias("tech_id"), F.when(i % 3 == 0, "Keep").alias("target"), (i % 2 == 0).alias("active")).where("target IS NOT NULL")
    return toggled(T.assets(spark, sf_dir).select("tech_id", "status"), presses)[1]


def queue_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the queue, and of those without a date."""
    return T.crawl_queue(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if(F.col("published_s").isNull()).alias("undated"))


def queue_without_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queue after the next batch is deleted by its addresses."""
    return without(T.crawl_queue(spark, sf_dir), queue_batch(spark, sf_dir)).select("queue_id", "source_url")


def favicon_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images that are a site's icon: found by pattern anywhere, then by path alone."""
    i = F.col("id").cast("string")
    df = T.items(spark, sf_dir, "id", "source_url").withColumn("icon", urls.favicon(F.col("source_url")))
    image = F.when(F.col("id") % 5 == 0, F.col("icon")).when(F.col("id") % 5 == 1, F.concat("icon", F.lit("?v="), i)).when(F.col("id") % 5 == 2, F.concat("icon", F.lit("#x"))).when(F.col("id") % 5 == 3, F.concat(F.lit("https://img.example.com/a.png?of=/favicon.ico?"), i)).otherwise(F.lit("https://img.example.com/favicon.ico.png"))
    df = df.select("id", image.alias("image_url"))
    near = F.col("image_url").like("%/favicon.ico") | F.col("image_url").like("%/favicon.ico?%") | F.col("image_url").like("%/favicon.ico#%")
    return df.where(near & urls.is_favicon(F.col("image_url")))


def safe_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether addresses made of samples may be fetched, by host alone."""
    hosts = F.lit([u for u, _ in ADDRESS_SAMPLES])
    url = F.element_at(hosts, (F.col("page_id") % len(ADDRESS_SAMPLES) + 1).cast("int"))
    return T.read(spark, sf_dir, "pages").select("page_id", X.safe_address(url).alias("safe"))


#: Addresses and whether they may be fetched.
ADDRESS_SAMPLES = [
    ("https://example.org/a", True), ("http://8.8.8.8/", True), ("http://127.0.0.1:80/", False), ("https://10.1.2.3/x", False), ("http://[::1]/", False), ("http://192.168.0.9/", False), ("http://169.254.169.254/meta", False),
    ("https://LOCALHOST./", False), ("http://db.internal/", False), ("http://printer.local/", False), ("ftp://example.org/", False), ("no address", False), ("http://[2001:4860:4860::8888]/", True), ("http://user@100.64.0.1/", False),
]


def asset_keep_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last history row of each asset, as a clean-up that keeps one row per key would leave it."""
    return latest(T.history(spark, sf_dir), "asset_id", F.desc("changed_s"), F.desc("history_id")).select("asset_id", "history_id", "changed_to")


def asset_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome of a batch of requests (one for every item, wanted status by id): CREATED without asset, NOOP if it has the status,
    else TRANSITIONED; a created asset writes no history."""
    i = F.col("doc_id")
    wanted = T.read(spark, sf_dir, "documents").select(i.alias("tech_id"), F.when(i % 3 == 0, "Keep").otherwise("Archived").alias("wanted"))
    df = wanted.join(T.assets(spark, sf_dir).select("tech_id", "status"), "tech_id", "left")
    outcome = F.when(F.col("status").isNull(), "CREATED").when(F.col("status") == F.col("wanted"), "NOOP").otherwise("TRANSITIONED")
    return df.select("tech_id", "wanted", F.col("status").alias("old_status"), outcome.alias("outcome"), (outcome == "TRANSITIONED").alias("writes_history"))


def outcomes_in_turn(requests: DataFrame, assets: DataFrame, block_s: int = T.DAY) -> DataFrame:
    """Outcomes of requests (request_id, tech_id, wanted, at_s), any number for an item, each judged by what the one before it left (by time, then id);
    assets has the statuses before all. CREATED without asset, NOOP if it has the status, else TRANSITIONED, which alone writes history.

    Requests before in the same block of time are found by a window over item and block, earlier ones by what each block left. So an item with
    a large share of all requests is spread over its blocks, and only one row a block meets in one place."""
    block = F.floor(F.col("at_s") / block_s).alias("block")
    rows = requests.select("request_id", "tech_id", "wanted", "at_s", block)
    left = rows.groupBy("tech_id", "block").agg(F.max_by("wanted", F.struct("at_s", "request_id")).alias("left"))
    carried = left.withColumn("carried", F.lag("left").over(Window.partitionBy("tech_id").orderBy("block"))).join(assets.select("tech_id", "status"), "tech_id", "left")
    carried = carried.select("tech_id", "block", F.coalesce("carried", "status").alias("carried"))
    inside = F.lag("wanted").over(Window.partitionBy("tech_id", "block").orderBy("at_s", "request_id"))
    df = rows.withColumn("inside", inside).join(carried, ["tech_id", "block"]).withColumn("old_status", F.coalesce("inside", "carried"))
    outcome = F.when(F.col("old_status").isNull(), "CREATED").when(F.col("old_status") == F.col("wanted"), "NOOP").otherwise("TRANSITIONED")
    return df.select("request_id", "tech_id", "wanted", "old_status", outcome.alias("outcome"), (outcome == "TRANSITIONED").alias("writes_history"))


def asset_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of all events read as requests for items: clicks and purchases keep, the others archive; items that don't exist get none."""
    e = T.read(spark, sf_dir, "events")
    wanted = F.when(F.col("event_type").isin("click", "purchase"), "Keep").otherwise("Archived")
    requests = e.select(F.col("event_id").alias("request_id"), (F.col("event_id") % 1500).alias("tech_id"), wanted.alias("wanted"), T.seconds("ts").alias("at_s"))
    ids = T.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("tech_id"))
    return outcomes_in_turn(requests.join(ids, "tech_id", "left_semi"), T.assets(spark, sf_dir))


def handoff_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per replacing edge: what archiving the predecessor and keeping the successor does; committed if the edge is no
    loop, or if nothing changes."""
    a = T.assets(spark, sf_dir).select("tech_id", "status")
    edges = T.succession(spark, sf_dir).where("relation = 'Replace'").select("pred", "succ")
    df = edges.join(a.select(F.col("tech_id").alias("pred"), F.col("status").alias("ps")), "pred", "left").join(a.select(F.col("tech_id").alias("succ"), F.col("status").alias("ss")), "succ", "left")
    out = lambda c, want: F.when(F.col(c).isNull(), "CREATED").when(F.col(c) == want, "NOOP").otherwise("TRANSITIONED")
    p, s = out("ps", "Archived"), out("ss", "Keep")
    return df.select("pred", "succ", p.alias("archived"), s.alias("kept"), ((F.col("pred") != F.col("succ")) | ((p == "NOOP") & (s == "NOOP"))).alias("committed"))


def event_batch_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of an event batch that are taken: known kind, an id that parses and exists; a value that doesn't parse is null."""
    e = T.read(spark, sf_dir, "events")
    i = F.col("event_id")
    raw = e.select(i, "event_type", F.when(i % 13 == 0, "not-an-id").otherwise((i % 1500).cast("string")).alias("raw_id"), F.when(i % 7 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("raw_value"))
    kinds = F.when(F.col("event_type") == "view", "impression").when(F.col("event_type") == "click", "click").when(F.col("event_type") == "purchase", "dwell")
    ids = T.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("tech_id"))
    df = raw.select("event_id", kinds.alias("kind"), F.expr("try_cast(raw_id AS BIGINT)").alias("tech_id"), F.expr("try_cast(raw_value AS DOUBLE)").alias("value"))
    return df.where("kind IS NOT NULL AND tech_id IS NOT NULL").join(ids, "tech_id", "left_semi").select("event_id", "kind", "tech_id", "value")


def favicon_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images for items that have none: the site's favicon; what is there already stays (every tenth item has one)."""
    df = T.items(spark, sf_dir, "id", "source_url").select("id", "source_url", F.when(F.col("id") % 10 == 0, F.concat(F.lit("https://img/"), F.col("id").cast("string"))).alias("image_url"))
    return df.select("id", F.coalesce("image_url", urls.favicon(F.col("source_url"))).alias("image_url"))


def digest_candidates(spark: SparkSession, sf_dir: str, least: int = 1000) -> DataFrame:
    """Items long enough for a digest."""
    return T.items(spark, sf_dir, "id", "raw_content").select("id", F.char_length(F.trim("raw_content")).alias("n")).where(F.col("n") >= least)


def digest_accepted(digest: Column, summary: Column, least: int = 150) -> Column:
    """Whether a digest is long enough and not the summary again, by case and white space."""
    fold = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    return F.coalesce((F.char_length(digest) >= least) & (fold(digest) != F.coalesce(fold(summary), F.lit(""))), F.lit(False))


def added(requests: DataFrame, known: DataFrame) -> DataFrame:
    """Outcome and reason of requests (url, final_url after redirects, content, failure of the fetch, triage_error, is_valid, saved) to add an address,
    the first that applies: refused by form or by a host inside a network, known already, not fetched, empty, known under its final address, not judged, judged
    unfit, not saved; else created. known: (source_url)."""
    there = known.select("source_url").distinct()
    df = requests.join(there.select(F.col("source_url").alias("url"), F.lit(True).alias("_known")), "url", "left")
    df = df.join(there.select(F.col("source_url").alias("final_url"), F.lit(True).alias("_known_then")), "final_url", "left")
    form = urls.url_status(F.col("url"))
    steps = [
        (form != "ok", "rejected", form),
        (~X.safe_address("url"), "rejected", F.lit("inner_host")),
        (F.col("_known"), "duplicate", F.lit("known")),
        (F.col("failure").isNotNull(), "error", F.concat(F.lit("fetch: "), "failure")),
        (X.stripped(F.coalesce("content", F.lit(""))) == "", "error", F.lit("empty")),
        (F.col("_known_then"), "duplicate", F.lit("known_after_redirect")),
        (F.col("triage_error").isNotNull(), "error", F.lit("triage")),
        (~F.coalesce("is_valid", F.lit(False)), "rejected", F.lit("unfit")),
        (~F.coalesce("saved", F.lit(False)), "error", F.lit("not_saved")),
    ]
    outcome, reason = F.lit("created"), F.lit(None).cast("string")
    for applies, what, why in reversed(steps):
        outcome, reason = F.when(applies, what).otherwise(outcome), F.when(applies, why).otherwise(reason)
    return df.withColumns({"outcome": outcome, "reason": reason}).drop("_known", "_known_then")


def add_url_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of adding the pages' addresses, which fail in every way by id."""
    i = F.col("page_id")
    k = i % 13
    u = F.col("url")
    requests = T.read(spark, sf_dir, "pages").select(
        i, F.when(k == 0, "").when(k == 1, F.concat(F.lit("ftp:"), F.substring_index(u, ":", -1))).when(k == 2, F.lit("http://127.0.0.1/x")).when(k == 3, u).otherwise(F.concat(u, F.lit("#new"))).alias("url"),
        F.when(k == 6, u).otherwise(F.concat(u, F.lit("#new"))).alias("final_url"), F.when(k == 5, " \n ").otherwise("text").alias("content"), F.when(k == 4, "timeout").alias("failure"),
        F.when(k == 7, "down").alias("triage_error"), (k != 8).alias("is_valid"), (k != 9).alias("saved"),
    )
    return added(requests, T.items(spark, sf_dir, "source_url")).select("page_id", "outcome", "reason")


def title_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles that cleaning changes, as they become; every fourth is kept with mark-up."""
    kept = T.items(spark, sf_dir, "id", "title").withColumn("kept", F.when(F.col("id") % 4 == 0, F.concat(F.lit("<b>"), "title", F.lit("</b>"))).otherwise(F.regexp_replace("title", r"\s+", " ")))
    return kept.withColumn("new", X.clean_title("kept")).where(F.col("new") != F.col("kept")).select("id", "new")


def digest_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items without a digest that get one: long enough, and answered (made from the id) with enough that isn't the summary; what has one keeps it."""
    i = F.col("id")
    answer = X.drop_think(F.concat(F.lit("<think>x</think>"), F.repeat(F.lit("word "), (i % 60).cast("int"))))
    df = T.items(spark, sf_dir, "id", "raw_content").withColumns({"digest": F.when(i % 10 == 0, "there"), "answer": answer, "summary": F.when(i % 7 == 0, F.upper(answer))})
    fits = (F.char_length(X.stripped(F.coalesce("raw_content", F.lit("")))) >= 1000) & digest_accepted(F.col("answer"), F.col("summary"))
    return df.where(F.col("digest").isNull() & fits).select("id", F.char_length("answer").alias("n"))


def trust_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items without a rubric with one from answers (by id: parsable or not), and trust with today's corroboration."""
    from lodestar.functions import scores
    from lodestar.operators.batch import rubric_of

    i = F.col("id")
    answer = F.when(i % 5 == 0, "no json").otherwise(F.concat(F.lit('{"is_valid": true, "reason": "r", "is_primary_source": '), F.when(i % 2 == 0, "true").otherwise("null"), F.lit(', "claim_evidence_balance": "BALANCED", "marketing_intensity": "medium"}')))
    df = T.items(spark, sf_dir, "id", "source_url", "corroboration_count", "has_rubric").where(~F.col("has_rubric")).withColumn("answer", answer)
    df = rubric_of(df, "answer").where("readable")
    trust = scores.synthesize_trust(scores.score_rubric(*[F.col(c) for c in T.RUBRIC[1:]]), scores.source_prior(urls.domain(F.col("source_url"))), scores.corroboration_score(F.col("corroboration_count")))
    return df.select("id", F.round(trust, 6).alias("trust"))


def resolve_events(spark: SparkSession, sf_dir: str, hops: int = HOPS) -> DataFrame:
    """Each event's surviving event: pointers are followed until there is none, one was seen before, or hops are used up."""
    t = T.tech_events(spark, sf_dir).select("event_id", "merged_into")
    df = t.select("event_id", F.col("event_id").alias("at"), F.array("event_id").alias("seen"))
    pointers = t.where("merged_into IS NOT NULL").select(F.col("event_id").alias("at"), F.col("merged_into").alias("to"))
    for _ in range(hops):
        step = df.join(pointers, "at", "left")
        go = F.col("to").isNotNull() & ~F.array_contains("seen", F.col("to"))
        df = step.select("event_id", F.when(go, F.col("to")).otherwise(F.col("at")).alias("at"), F.when(go, F.array_append("seen", F.col("to"))).otherwise(F.col("seen")).alias("seen"))
    return df.select("event_id", F.col("at").alias("resolved_id"))


def event_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of every event, newest published first, those without a date last."""
    df = T.event_documents(spark, sf_dir).join(T.items(spark, sf_dir, "id", "title", "published_s").withColumnRenamed("id", "tech_id"), "tech_id")
    return df.orderBy("event_id", F.col("published_s").desc_nulls_last(), "tech_id").select("event_id", "tech_id", "title", "published_s")


def entities_by_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of every event by name."""
    return T.event_entities(spark, sf_dir).orderBy("event_id", "entity").select("event_id", "entity")


def events_for_entity(spark: SparkSession, sf_dir: str, name: str = "  Small   GEAR ") -> DataFrame:
    """Events of an entity, newest first, its name normalised first; of all entities for an empty name."""
    key = " ".join(name.split()).lower()
    df = T.event_entities(spark, sf_dir)
    df = df.where(F.col("entity") == key) if key else df
    return df.join(T.tech_events(spark, sf_dir), "event_id").orderBy(F.desc("occurred_s"), "event_id", "entity").select("entity", "event_id", "occurred_s")


def feed_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by kind, and how many point at no item."""
    ids = T.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("tech_id"), F.lit(1).alias("there"))
    return T.feed_events(spark, sf_dir).join(ids, "tech_id", "left").groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.col("there").isNull()).alias("dangling"), F.round(F.avg("value"), 4).alias("mean_value"))
