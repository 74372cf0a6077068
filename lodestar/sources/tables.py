"""The domain views over the driver's tables, in Spark and as SQL for the oracle.

Times are whole seconds since 1970 (UTC), so no result depends on a session's time zone. Every read that needs
"now" takes it as an argument; AS_OF is the value that the registered queries use.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = 1706659200  # 2024-01-31 00:00:00
DAY = 86400
WEEK = 7 * DAY


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def first_line(text: Column, limit: int = 500) -> Column:
    """The first line that isn't blank, cut; 'Untitled' without one."""
    return F.coalesce(F.left(F.trim(F.get(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""), F.lit(0))), F.lit(limit)), F.lit("Untitled"))


def _since(seed: int, column: Column) -> Column:
    return F.lit(AS_OF) - (column * seed) % 43200 * 60


RUBRIC = ["has_rubric", "primary_source", "has_links", "has_numbers", "balance", "marketing"]
ITEM = ["id", "title", "source_url", "raw_content", "source", "lang", "n_chars", "category", "created_s", "published_s", "eff_s", *RUBRIC, "corroboration_count", "embedding"]


def own_url(i: Column) -> Column:
    """Addresses at the known sources for some ids, null for the others."""
    n = i.cast("string")
    return (
        F.when(i % 23 == 0, F.concat(F.lit("https://github.com/own"), n, F.lit("/repo"), n))
        .when(i % 29 == 0, F.concat(F.lit("https://news.ycombinator.com/item?id="), n))
        .when(i % 31 == 0, F.concat(F.lit("https://www.arxiv.org/abs/2401."), F.lpad(n, 5, "0")))
    )


def items(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """tech items: documents with page address, embedding and a trust rubric where there is a label. Only the tables that the columns
    asked for (all of ITEM if none) come from are joined, and only their columns are read."""
    wanted = set(columns or ITEM)
    df = read(spark, sf_dir, "documents")
    if "embedding" in wanted:
        df = df.join(read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left")
    if "source_url" in wanted:
        df = df.join(read(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "url"), "doc_id", "left")
    if wanted & set(RUBRIC):
        df = df.join(read(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), "doc_id", "left")
    i = F.col("doc_id")
    created = _since(7919, i)
    has = F.col("quality").isNotNull()
    made = {
        "id": i,
        "title": first_line(F.col("text")),
        "source_url": F.coalesce(own_url(i), "url", F.concat(F.lit("https://"), "source", F.lit(".example.com/d/"), i.cast("string"))),
        "raw_content": F.col("text"),
        "category": F.when(i % 7 == 6, None).when(i % 2 == 0, "Mainstream").otherwise("Alpha"),
        "created_s": created,
        "published_s": F.when(i % 5 != 0, created - i % 72 * 3600),
        "eff_s": F.when(i % 5 != 0, created - i % 72 * 3600).otherwise(created),
        "has_rubric": has,
        "primary_source": has & (F.col("quality") == 1),
        "has_links": has & (i % 3 == 0),
        "has_numbers": has & (F.col("n_chars") % 2 == 0),
        "balance": F.when(has, F.element_at(F.array(F.lit("balanced"), F.lit("mixed"), F.lit("unsupported")), (i % 3 + 1).cast("int"))),
        "marketing": F.when(has, F.when(F.col("toxic") == 1, "high").when(i % 2 == 0, "low").otherwise("medium")),
        "corroboration_count": F.when(i % 4 != 0, i % 3),
    }
    return df.select(*[made.get(c, F.col(c)).alias(c) for c in columns or ITEM])


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One asset for each item whose id ends in 0 to 3."""
    i = F.col("doc_id")
    return read(spark, sf_dir, "documents").where(i % 10 < 4).select(
        (i + 1_000_000).alias("asset_id"), i.alias("tech_id"),
        F.when(i % 10 < 2, "Keep").when(i % 10 == 2, "Archived").otherwise("Tracking").alias("status"),
        _since(104729, i).alias("asset_created_s"),
    )


def seconds(ts: str) -> Column:
    """A timestamp without zone as seconds, whatever the session's zone."""
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})")


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shared log: transitions (changed_to is a status) and alerts (changed_from holds another item's id)."""
    e = read(spark, sf_dir, "events").select("event_id", "event_type", seconds("ts").alias("changed_s"), (F.col("user_id") % 20 * 10 + F.col("event_id") % 4).alias("tech_id"))
    kind = F.col("event_type")
    alert = F.when(F.col("event_id") % 3 == 0, "Keep").otherwise((F.col("tech_id") + 1 + F.col("tech_id") % 3).cast("string"))
    return e.join(assets(spark, sf_dir).select("tech_id", "asset_id"), "tech_id").select(
        F.col("event_id").alias("history_id"), "asset_id", "tech_id", "changed_s",
        F.when(kind == "purchase", (F.col("event_id") * 31 % 1200).cast("string")).when(kind == "signup", alert).otherwise("Keep").alias("changed_from"),
        F.when(kind == "click", "Keep").when(kind == "view", "Tracking").when(kind == "error", "Archived").when(kind == "purchase", "signal_matched").otherwise("succession_alerted").alias("changed_to"),
    )


def succession(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineage edges between existing items, some of them loops, some from a passed item to a kept one."""
    ids = read(spark, sf_dir, "documents").select("doc_id")
    i = F.col("doc_id")
    edges = ids.where(i % 6 < 3).select(
        i.alias("pred"), F.when(i % 97 == 0, i).when(i % 30 == 12, i + 8).otherwise(i + 1 + i % 3).alias("succ"),
        F.element_at(F.array(F.lit("Replace"), F.lit("Enhance"), F.lit("Fork")), (i % 3 + 1).cast("int")).alias("relation"),
        _since(15485863, i).alias("edge_s"),
    )
    return edges.join(ids.select(i.alias("succ")), "succ", "left_semi")


def feed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Impressions, clicks and dwell times; some point at items that don't exist."""
    kind = F.col("event_type")
    return read(spark, sf_dir, "events").where(kind.isin("view", "click", "purchase")).select(
        "event_id", F.when(kind == "view", "Impression").when(kind == "click", "Click").otherwise("Dwell").alias("kind"),
        (F.col("event_id") % 1500).alias("tech_id"), F.when(kind == "purchase", F.col("value")).alias("value"), seconds("ts").alias("at_s"),
    )


def crawl_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The staging queue."""
    i = F.col("page_id")
    return read(spark, sf_dir, "pages").select(i.alias("queue_id"), F.col("url").alias("source_url"), F.when(i % 4 != 0, F.lit(AS_OF) - i * 977 % 43200 * 60).alias("published_s"), (F.lit(AS_OF) - i * 613 % 43200 * 60).alias("queued_s"))


def tech_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event per conversation; merged_into is the tombstone pointer."""
    i = F.col("conv_id")
    return read(spark, sf_dir, "conversations").select(i).distinct().select(
        i.alias("event_id"), (F.lit(AS_OF) - i * 3571 % 43200 * 60).alias("occurred_s"),
        F.when(i.between(1, 12), i - 1).when(i == 15, 16).when(i == 16, 15).when(i == 17, 17).alias("merged_into"),
    )


def event_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of events to items that exist."""
    ids = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("tech_id"))
    links = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("event_id"), (F.col("conv_id") * 7 + F.col("turn")).alias("tech_id")).distinct()
    return links.join(ids, "tech_id", "left_semi")


def entity_key(name: Column) -> Column:
    """White space collapsed, lower case."""
    return F.lower(F.trim(F.regexp_replace(name, r"\s+", " ")))


def event_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of events to entities (normalised part names)."""
    n = read(spark, sf_dir, "conversations").agg(F.count_distinct("conv_id").alias("n"))
    p = read(spark, sf_dir, "part").crossJoin(F.broadcast(n))  # one row
    return p.select((F.col("p_partkey") % F.col("n")).alias("event_id"), entity_key(F.col("p_name")).alias("entity")).distinct()


#: The same views as common table expressions.
VIEWS_SQL = f"""WITH items AS (
  SELECT d.doc_id AS id,
    coalesce(left(trim(list_filter(string_split(d.text, chr(10)), lambda x: trim(x) <> '')[1]), 500), 'Untitled') AS title,
    coalesce(CASE WHEN d.doc_id % 23 = 0 THEN 'https://github.com/own' || d.doc_id || '/repo' || d.doc_id WHEN d.doc_id % 29 = 0 THEN 'https://news.ycombinator.com/item?id=' || d.doc_id
      WHEN d.doc_id % 31 = 0 THEN 'https://www.arxiv.org/abs/2401.' || lpad(d.doc_id::VARCHAR, 5, '0') END, p.url, 'https://' || d.source || '.example.com/d/' || d.doc_id) AS source_url,
    d.text AS raw_content, d.source, d.lang, d.n_chars,
    CASE WHEN d.doc_id % 7 = 6 THEN NULL WHEN d.doc_id % 2 = 0 THEN 'Mainstream' ELSE 'Alpha' END AS category,
    {AS_OF} - (d.doc_id * 7919) % 43200 * 60 AS created_s,
    CASE WHEN d.doc_id % 5 <> 0 THEN {AS_OF} - (d.doc_id * 7919) % 43200 * 60 - d.doc_id % 72 * 3600 END AS published_s,
    coalesce(CASE WHEN d.doc_id % 5 <> 0 THEN {AS_OF} - (d.doc_id * 7919) % 43200 * 60 - d.doc_id % 72 * 3600 END, {AS_OF} - (d.doc_id * 7919) % 43200 * 60) AS eff_s,
    l.quality IS NOT NULL AS has_rubric,
    coalesce(l.quality = 1, false) AS primary_source,
    (l.quality IS NOT NULL AND d.doc_id % 3 = 0) AS has_links,
    (l.quality IS NOT NULL AND d.n_chars % 2 = 0) AS has_numbers,
    CASE WHEN l.quality IS NOT NULL THEN ['balanced', 'mixed', 'unsupported'][d.doc_id % 3 + 1] END AS balance,
    CASE WHEN l.quality IS NULL THEN NULL WHEN l.toxic = 1 THEN 'high' WHEN d.doc_id % 2 = 0 THEN 'low' ELSE 'medium' END AS marketing,
    CASE WHEN d.doc_id % 4 <> 0 THEN d.doc_id % 3 END AS corroboration_count,
    e.embedding
  FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id LEFT JOIN pages p ON p.page_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id),
assets AS (
  SELECT doc_id + 1000000 AS asset_id, doc_id AS tech_id,
    CASE WHEN doc_id % 10 < 2 THEN 'Keep' WHEN doc_id % 10 = 2 THEN 'Archived' ELSE 'Tracking' END AS status,
    {AS_OF} - (doc_id * 104729) % 43200 * 60 AS asset_created_s
  FROM documents WHERE doc_id % 10 < 4),
history AS (
  SELECT e.event_id AS history_id, a.asset_id, a.tech_id, floor(epoch(e.ts))::BIGINT AS changed_s,
    CASE e.event_type WHEN 'purchase' THEN (e.event_id * 31 % 1200)::VARCHAR
      WHEN 'signup' THEN CASE WHEN e.event_id % 3 = 0 THEN 'Keep' ELSE (a.tech_id + 1 + a.tech_id % 3)::VARCHAR END ELSE 'Keep' END AS changed_from,
    CASE e.event_type WHEN 'click' THEN 'Keep' WHEN 'view' THEN 'Tracking' WHEN 'error' THEN 'Archived' WHEN 'purchase' THEN 'signal_matched' ELSE 'succession_alerted' END AS changed_to
  FROM events e JOIN assets a ON a.tech_id = e.user_id % 20 * 10 + e.event_id % 4),
succession AS (
  SELECT * FROM (SELECT doc_id AS pred, CASE WHEN doc_id % 97 = 0 THEN doc_id WHEN doc_id % 30 = 12 THEN doc_id + 8 ELSE doc_id + 1 + doc_id % 3 END AS succ,
    ['Replace', 'Enhance', 'Fork'][doc_id % 3 + 1] AS relation, {AS_OF} - (doc_id * 15485863) % 43200 * 60 AS edge_s
  FROM documents WHERE doc_id % 6 < 3) WHERE succ IN (SELECT doc_id FROM documents)),
feed_events AS (
  SELECT event_id, CASE event_type WHEN 'view' THEN 'Impression' WHEN 'click' THEN 'Click' ELSE 'Dwell' END AS kind,
    event_id % 1500 AS tech_id, CASE WHEN event_type = 'purchase' THEN value END AS value, floor(epoch(ts))::BIGINT AS at_s
  FROM events WHERE event_type IN ('view', 'click', 'purchase')),
crawl_queue AS (
  SELECT page_id AS queue_id, url AS source_url, CASE WHEN page_id % 4 <> 0 THEN {AS_OF} - page_id * 977 % 43200 * 60 END AS published_s, {AS_OF} - page_id * 613 % 43200 * 60 AS queued_s FROM pages),
tech_events AS (
  SELECT event_id, {AS_OF} - event_id * 3571 % 43200 * 60 AS occurred_s,
    CASE WHEN event_id BETWEEN 1 AND 12 THEN event_id - 1 WHEN event_id = 15 THEN 16 WHEN event_id = 16 THEN 15 WHEN event_id = 17 THEN 17 END AS merged_into
  FROM (SELECT DISTINCT conv_id AS event_id FROM conversations)),
event_documents AS (
  SELECT DISTINCT conv_id AS event_id, conv_id * 7 + turn AS tech_id FROM conversations WHERE conv_id * 7 + turn IN (SELECT doc_id FROM documents)),
event_entities AS (
  SELECT DISTINCT p_partkey % (SELECT count(DISTINCT conv_id) FROM conversations) AS event_id, lower(trim(regexp_replace(p_name, '\\s+', ' ', 'g'))) AS entity FROM part)
"""
