"""Feed, portfolio, timeline, detail, activity, weekly and stats reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from lodestar.functions import scores, urls
from lodestar.sources import tables as T
from lodestar.sources.tables import AS_OF, DAY, WEEK

STATUSES = ["Keep", "Tracking", "Archived"]
ALERTS = ["succession_alerted", "signal_matched"]
HERO_S = 48 * 3600


SLIM = ["id", "source_url", "category", "created_s", "published_s", "eff_s", "corroboration_count"]


def slim_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with what lists sort and filter by. No text is read: titles are looked up for the rows that are left."""
    return T.items(spark, sf_dir, *SLIM, *T.RUBRIC).select(*SLIM, scores.item_trust(urls.domain(F.col("source_url"))).alias("trust"))


def scored_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """slim_items with feed_score without the profile term, null for every ninth item (not scored yet)."""
    age = (F.lit(AS_OF) - F.col("eff_s")) / 3600
    score = 0.35 * scores.recency_decay(age) + 0.15 * F.coalesce("trust", F.lit(0.0)) + 0.15 * scores.trending_score(F.col("corroboration_count"))
    return slim_items(spark, sf_dir).withColumn("feed_score", F.when(F.col("id") % 9 != 8, F.round(score, 6)))


def with_status(items: DataFrame, assets: DataFrame) -> DataFrame:
    return items.join(assets.select(F.col("tech_id").alias("id"), "status"), "id", "left")


def page(df: DataFrame, *order: Column, limit: int) -> DataFrame:
    """The first limit rows in order as a local table with their place: a page is bounded by its limit, so what is looked up for
    it can be filtered by its ids at the scan."""
    rows = df.orderBy(*order).limit(limit).collect()
    return df.sparkSession.createDataFrame([(k, *r) for k, r in enumerate(rows)], StructType([StructField("place", IntegerType()), *df.schema.fields]))


def with_titles(found: DataFrame, spark: SparkSession, sf_dir: str, key: str = "id") -> DataFrame:
    """A page with titles; the scan of texts is filtered by the page's ids."""
    ids = [r[0] for r in found.select(key).collect() if r[0] is not None]
    titles = T.items(spark, sf_dir, "id", "title").where(F.col("id").isin(ids)).withColumnRenamed("id", key)
    return found.join(titles, key, "left")


CARD = ["id", "title", "category", "eff_s", "trust", "feed_score", "status"]
SORTS = ["recommended", "latest"]
CATEGORIES = ["Mainstream", "Alpha"]


def normalised(sort: str | None, category: str | None) -> tuple[str, str | None]:
    """What a reader's raw choice stands for: an unknown order is the default one, an unknown category none."""
    return sort if sort in SORTS else SORTS[0], category if category in CATEGORIES else None


def feed(spark: SparkSession, sf_dir: str, sort: str = "recommended", category: str | None = None, cursor: tuple | None = None, limit: int = 20) -> DataFrame:
    """A page of the feed (limit + 1 rows: one more shows that there is a next page), in order. cursor is that of
    lodestar.operators.pages; a cursor of the other order is refused."""
    if sort not in SORTS:
        raise ValueError(f"unknown sort: {sort}")
    if category not in (None, *CATEGORIES):
        raise ValueError(f"unknown category: {category}")
    df = scored_items(spark, sf_dir)
    if category:
        df = df.where(F.col("category") == category)
    order = [F.desc("eff_s"), F.desc("id")]
    if sort == "recommended":
        order = [F.col("feed_score").desc_nulls_last(), *order]
    if cursor:
        if cursor[0] != sort:
            raise ValueError("this cursor belongs to another order")
        df = df.where(after(sort, *cursor[1:]))
    found = page(df.select("id", "category", "eff_s", "trust", "feed_score"), *order, limit=limit + 1)
    cards = with_status(with_titles(found, spark, sf_dir), T.assets(spark, sf_dir).where(F.col("tech_id").isin([r.id for r in found.select("id").collect()])))
    return cards.orderBy("place").select(*CARD)


def after(sort: str, *key) -> Column:
    """Rows behind the cursor's: (eff_s, id), with feed_score in front for 'recommended'."""
    eff, i = key[-2:]
    later = (F.col("eff_s") < eff) | ((F.col("eff_s") == eff) & (F.col("id") < i))
    if sort == "latest":
        return later
    if key[0] is None:
        return F.col("feed_score").isNull() & later
    return F.col("feed_score").isNull() | (F.col("feed_score") < key[0]) | ((F.col("feed_score") == key[0]) & later)


def feed_hero(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest score within 48 hours, else of all: one pass."""
    df = scored_items(spark, sf_dir).where("feed_score IS NOT NULL")
    fresh = (F.col("eff_s") >= AS_OF - HERO_S).cast("int")
    best = df.agg(F.max(F.struct(fresh.alias("fresh"), "feed_score", "id", "eff_s")).alias("m")).where("m IS NOT NULL").select("m.*")
    found = page(best, F.col("id"), limit=1)
    return with_titles(found, spark, sf_dir).select("id", "title", "feed_score", F.col("fresh").cast("boolean").alias("fresh"))


def stats_summary(spark: SparkSession, sf_dir: str, since: int = AS_OF - WEEK) -> DataFrame:
    """One row of counts over the window."""
    items = T.items(spark, sf_dir, "id", "category", "created_s").where(F.col("created_s") >= since)
    joined = items.join(T.assets(spark, sf_dir).select(F.col("tech_id").alias("id"), "status"), "id", "left")
    one = joined.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("category").isNotNull()).alias("valid"),
        F.count_if(F.col("category") == "Mainstream").alias("mainstream"),
        F.count_if(F.col("category") == "Alpha").alias("alpha"),
        F.count_if(F.col("status") == "Keep").alias("kept"),
        F.count_if(F.col("status") == "Archived").alias("passed"),
        F.count_if(F.col("status").isNull() | (F.col("status") == "Tracking")).alias("unclassified"),
    )
    alerts = T.history(spark, sf_dir).where(F.col("changed_s") >= since).agg(F.count("*").alias("track_alerts"))
    return one.crossJoin(F.broadcast(alerts)).withColumn("valid_percent", scores.safe_percent(F.col("valid"), F.col("total")))


def source_mix(spark: SparkSession, sf_dir: str, since: int = AS_OF - WEEK) -> DataFrame:
    """Items of the window by source label."""
    df = T.items(spark, sf_dir, "source_url", "created_s").where(F.col("created_s") >= since)
    return df.groupBy(urls.source_label(F.col("source_url")).alias("label")).agg(F.count("*").alias("n"))


def lineage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that touch each kept item; a loop counts once."""
    ends = T.succession(spark, sf_dir).select(F.explode(F.array_distinct(F.array("pred", "succ"))).alias("tech_id")).groupBy("tech_id").agg(F.count("*").alias("n"))
    keep = T.assets(spark, sf_dir).where("status = 'Keep'").select("tech_id")
    return keep.join(ends, "tech_id", "left").select("tech_id", F.coalesce("n", F.lit(0)).alias("n_lineage"))


def portfolio(spark: SparkSession, sf_dir: str, sort: str = "recency", cursor: tuple | None = None, limit: int = 20) -> DataFrame:
    """A page of kept items with alert counts of the week, last activity and lineage; active says whether the week had an alert. cursor:
    (trust, activity_s, tech_id) of the row before; by recency its trust isn't looked at."""
    alerts = T.history(spark, sf_dir).groupBy("tech_id").agg(
        F.count_if(F.col("changed_to").isin(ALERTS) & (F.col("changed_s") >= AS_OF - WEEK)).alias("alerts_7d"), F.max("changed_s").alias("last_s")
    )
    df = slim_items(spark, sf_dir).select(F.col("id").alias("tech_id"), "trust").join(T.assets(spark, sf_dir).where("status = 'Keep'"), "tech_id").join(alerts, "tech_id", "left")
    df = df.select("tech_id", "trust", F.coalesce("alerts_7d", F.lit(0)).alias("alerts_7d"), F.coalesce("last_s", "asset_created_s").alias("activity_s"))
    order = [F.desc("activity_s"), F.desc("tech_id")] if sort == "recency" else [F.col("trust").desc_nulls_last(), F.desc("activity_s"), F.desc("tech_id")]
    if cursor:
        trust, at, i = cursor
        later = (F.col("activity_s") < at) | ((F.col("activity_s") == at) & (F.col("tech_id") < i))
        if sort == "recency":
            df = df.where(later)
        elif trust is None:
            df = df.where(F.col("trust").isNull() & later)
        else:
            df = df.where(F.col("trust").isNull() | (F.col("trust") < trust) | ((F.col("trust") == trust) & later))
    found = page(df, *order, limit=limit)
    lineage = lineage_counts(spark, sf_dir).where(F.col("tech_id").isin([r.tech_id for r in found.select("tech_id").collect()]))
    out = with_titles(found, spark, sf_dir, "tech_id").join(lineage, "tech_id", "left").withColumn("active", F.col("alerts_7d") > 0)
    return out.orderBy("place").select("tech_id", "title", "trust", "alerts_7d", "activity_s", "n_lineage", "active")


def user_portfolio(spark: SparkSession, sf_dir: str, sort: str = "date", category: str | None = None) -> DataFrame:
    """All kept items with trust and effective date, newest decision first or by trust."""
    df = slim_items(spark, sf_dir).join(T.assets(spark, sf_dir).where("status = 'Keep'").select(F.col("tech_id").alias("id"), "asset_created_s"), "id")
    if category:
        df = df.where(F.col("category") == category)
    df = df.join(T.items(spark, sf_dir, "id", "title"), "id")
    order = [F.desc("asset_created_s"), F.desc("id")]
    return df.orderBy(*([F.col("trust").desc_nulls_last()] if sort == "trust" else []), *order).select(F.col("id").alias("tech_id"), "title", "trust", "eff_s")


def portfolio_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept items by category; what has none, or an unknown one, counts as Mainstream."""
    df = T.items(spark, sf_dir, "id", "category").join(T.assets(spark, sf_dir).where("status = 'Keep'").select(F.col("tech_id").alias("id")), "id", "left_semi")
    return df.groupBy(F.when(F.col("category").isin(CATEGORIES), F.col("category")).otherwise("Mainstream").alias("category")).agg(F.count("*").alias("n"))


def weekly_report(spark: SparkSession, sf_dir: str, end: int = AS_OF) -> DataFrame:
    """Per kept item, by title: history rows of [end - 7 d, end) and successions by predecessor."""
    inside = lambda c: (F.col(c) >= end - WEEK) & (F.col(c) < end)
    signals = T.history(spark, sf_dir).where(inside("changed_s")).groupBy("tech_id").agg(F.count("*").alias("signals"))
    edges = T.succession(spark, sf_dir).where(inside("edge_s")).groupBy(F.col("pred").alias("tech_id")).agg(F.count("*").alias("successions"))
    keep = T.assets(spark, sf_dir).where("status = 'Keep'").select("tech_id")
    items = T.items(spark, sf_dir, "id", "title").withColumnRenamed("id", "tech_id")
    out = items.join(keep, "tech_id").join(signals, "tech_id", "left").join(edges, "tech_id", "left")
    return out.orderBy("title", "tech_id").select("tech_id", "title", F.coalesce("signals", F.lit(0)).alias("signals_7d"), F.coalesce("successions", F.lit(0)).alias("successions_7d"))


def _matched(newest: DataFrame, spark: SparkSession, sf_dir: str, limit: int) -> DataFrame:
    """A page of history, newest first, with the title of the item that a signal names; a signal whose item is gone stays, without title."""
    cut = page(newest, F.desc("own"), F.desc("changed_s"), F.desc("history_id"), limit=limit)
    named = cut.withColumn("matched_id", F.when(F.col("changed_to") == "signal_matched", F.col("changed_from").try_cast("long")))
    named = named.withColumn("matched_id", F.when(F.col("matched_id").cast("string") == F.col("changed_from"), F.col("matched_id")))
    out = with_titles(named, spark, sf_dir, "matched_id").withColumnRenamed("title", "matched_title")
    return out.orderBy("place").select("history_id", "tech_id", "changed_s", "changed_from", "changed_to", "matched_title")


def activity_ticker(spark: SparkSession, sf_dir: str, limit: int = 12) -> DataFrame:
    """The newest history rows of kept items."""
    keep = T.assets(spark, sf_dir).where("status = 'Keep'").select("asset_id")
    return _matched(T.history(spark, sf_dir).join(keep, "asset_id", "left_semi").withColumn("own", F.lit(True)), spark, sf_dir, limit)


def timeline_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of every kept item: transitions, signals whose item exists, and successions; an alert row that repeats an edge is
    left out, one with an old text in changed_from stays."""
    keep = T.assets(spark, sf_dir).where("status = 'Keep'").select("asset_id", "tech_id")
    history = T.history(spark, sf_dir).join(keep.select("asset_id"), "asset_id", "left_semi")
    status = history.where(F.col("changed_to").isin(STATUSES)).select("tech_id", F.lit("status").alias("kind"), F.col("changed_s").alias("at_s"), F.col("changed_to").alias("detail"), F.col("history_id").alias("ref"))
    ids = T.items(spark, sf_dir, "id").select(F.col("id").cast("string").alias("changed_from"))
    signal = history.where("changed_to = 'signal_matched'").join(ids, "changed_from", "left_semi").select("tech_id", F.lit("signal").alias("kind"), F.col("changed_s").alias("at_s"), F.col("changed_from").alias("detail"), F.col("history_id").alias("ref"))
    edges = T.succession(spark, sf_dir).select(F.col("pred").alias("tech_id"), "succ", "relation", "edge_s").join(keep.select("tech_id"), "tech_id", "left_semi")
    born = edges.select("tech_id", F.lit("succession").alias("kind"), F.col("edge_s").alias("at_s"), F.concat_ws(":", "relation", F.col("succ").cast("string")).alias("detail"), F.col("succ").alias("ref"))
    covered = edges.select("tech_id", F.col("succ").cast("string").alias("changed_from"))
    alerts = history.where("changed_to = 'succession_alerted'").join(covered, ["tech_id", "changed_from"], "left_anti")
    alert = alerts.select("tech_id", F.lit("succession").alias("kind"), F.col("changed_s").alias("at_s"), F.concat(F.lit("alert:"), "changed_from").alias("detail"), F.col("history_id").alias("ref"))
    return status.unionByName(signal).unionByName(born).unionByName(alert)


def timeline(spark: SparkSession, sf_dir: str, item: int, limit: int | None = None) -> DataFrame:
    """A kept item's events: what it took over from a passed predecessor first, whenever that was, then newest first; at one time
    status, signal, succession."""
    took = inferred_handoff(spark, sf_dir).where(F.col("tech_id") == item).select("tech_id", F.lit("handoff").alias("kind"), F.col("edge_s").alias("at_s"), F.col("pred").cast("string").alias("detail"), F.col("pred").alias("ref"))
    df = timeline_all(spark, sf_dir).where(F.col("tech_id") == item).unionByName(took)
    rank = F.when(F.col("kind") == "status", 0).when(F.col("kind") == "signal", 1).otherwise(2)
    out = df.orderBy(F.desc(F.col("kind") == "handoff"), F.desc("at_s"), rank, F.desc("ref"), "detail")
    return out if limit is None else out.limit(limit)


def inferred_handoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept items that replaced an archived one: the earliest such edge."""
    a = T.assets(spark, sf_dir)
    keep, gone = a.where("status = 'Keep'").select(F.col("tech_id").alias("succ")), a.where("status = 'Archived'").select(F.col("tech_id").alias("pred"))
    edges = T.succession(spark, sf_dir).where("relation = 'Replace' AND pred <> succ").join(keep, "succ").join(gone, "pred")
    return edges.groupBy("succ").agg(F.min(F.struct("edge_s", "pred")).alias("m")).select(F.col("succ").alias("tech_id"), F.col("m.pred").alias("pred"), F.col("m.edge_s").alias("edge_s"))


def replace_successors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first replacement of every asset's item, loops left out."""
    edges = T.succession(spark, sf_dir).where("relation = 'Replace' AND pred <> succ")
    first = edges.groupBy("pred").agg(F.min(F.struct("edge_s", "succ")).alias("m"))
    return first.join(T.assets(spark, sf_dir).select(F.col("tech_id").alias("pred"), "asset_id"), "pred").select("asset_id", "pred", F.col("m.succ").alias("succ"))


def detail_edges(spark: SparkSession, sf_dir: str, towards: str) -> DataFrame:
    """Neighbours of every item along the edges, with title and status."""
    own, other = ("succ", "pred") if towards == "pred" else ("pred", "succ")
    edges = T.succession(spark, sf_dir).select(F.col(own).alias("item_id"), F.col(other).alias("id"), "relation")
    return with_status(edges.join(T.items(spark, sf_dir, "id", "title"), "id"), T.assets(spark, sf_dir)).select("item_id", F.col("id").alias("other_id"), "title", "relation", "status")


def detail_log(spark: SparkSession, sf_dir: str, viewed: int, alerts: bool, limit: int = 10) -> DataFrame:
    """History (or alerts) of the viewed item and its asset's neighbours by lineage, the viewed item's own first."""
    scope = T.succession(spark, sf_dir).where((F.col("pred") == viewed) | (F.col("succ") == viewed)).select(F.explode(F.array("pred", "succ")).alias("tech_id")).union(spark.range(1).select(F.lit(viewed).cast("long"))).distinct()
    log = T.history(spark, sf_dir).where(F.col("changed_to").isin(ALERTS if alerts else STATUSES)).join(scope, "tech_id", "left_semi")
    log = log.withColumn("own", F.col("tech_id") == viewed)
    if alerts:
        return _matched(log, spark, sf_dir, limit)
    return log.orderBy(F.desc("own"), F.desc("changed_s"), F.desc("history_id")).limit(limit).select("history_id", "tech_id", "changed_s", "changed_from", "changed_to")


def rolling_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals of each item over every window of seven days, one day apart."""
    log = T.history(spark, sf_dir).where(F.col("changed_to").isin(ALERTS))
    day = F.floor(F.col("changed_s") / DAY)
    return log.select("tech_id", F.explode(F.sequence(day - 6, day)).alias("first_day")).groupBy("tech_id", "first_day").agg(F.count("*").alias("signals"))
