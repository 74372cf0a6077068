"""Vector search, corroboration, profile and feed scores, briefing, and signal and succession alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions import scores, urls, vectors
from lodestar.operators import reads
from lodestar.operators.reads import page, slim_items, with_titles
from lodestar.sources import tables as T
from lodestar.sources.tables import AS_OF, DAY, WEEK

#: A threshold at which the driver's vectors have pairs; the default of the settings is 0.85.
NEAR, PAIR = 0.30, 0.35


def embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, vector) of the items that have one."""
    docs = T.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    return T.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")).where(F.col("vector").isNotNull()).join(docs, "id", "left_semi")


def search_topk(spark: SparkSession, sf_dir: str, query: list[float] | None = None, k: int = 10, category: str | None = None, status: str | None = None) -> DataFrame:
    """The k items nearest to a query vector (default: that of item 0), ties by id, with the category in any case and, for status 'keep', kept items
    alone. k is kept within 1 and 50."""
    k = max(1, min(50, k))
    df = embedded(spark, sf_dir)
    if query is None:
        row = df.where("id = 0").agg(F.first("vector").alias("q"))
    else:
        row = spark.range(1).select(F.lit(query).cast("array<double>").alias("q"))
    near = df.crossJoin(F.broadcast(row)).select("id", F.round(1 - vectors.cosine(F.col("vector"), F.col("q")), 6).alias("distance"))  # one row
    categories = T.items(spark, sf_dir, "id", "category")
    if category:
        near = near.join(categories.where(F.col("category") == category.capitalize()).select("id"), "id", "left_semi")
    if status == "keep":
        near = near.join(T.assets(spark, sf_dir).where("status = 'Keep'").select(F.col("tech_id").alias("id")), "id", "left_semi")
    top = page(near, F.col("distance"), F.col("id"), limit=k)
    found = with_titles(top, spark, sf_dir).join(categories.where(F.col("id").isin([r.id for r in top.select("id").collect()])), "id")
    return found.orderBy("place").select("id", "distance", "title", "category")


def context_topn(spark: SparkSession, sf_dir: str, anchor: int = 1, n: int = 3, chars: int = 300, least_items: int = 50) -> DataFrame:
    """The n items nearest to an item, with the start of their texts; none before least_items items have vectors."""
    df = embedded(spark, sf_dir)
    row = df.agg(F.count("*").alias("n"), F.first(F.when(F.col("id") == anchor, F.col("vector")), ignorenulls=True).alias("q")).where((F.col("n") >= least_items) & F.col("q").isNotNull()).select("q")
    near = df.where(F.col("id") != anchor).crossJoin(F.broadcast(row)).select("id", F.round(1 - vectors.cosine(F.col("vector"), F.col("q")), 6).alias("distance"))  # one row
    top = page(near, F.col("distance"), F.col("id"), limit=n)
    texts = T.read(spark, sf_dir, "documents").where(F.col("doc_id").isin([r.id for r in top.select("id").collect()])).select(F.col("doc_id").alias("id"), F.left("text", F.lit(chars)).alias("context"))
    return top.join(texts, "id").orderBy("place").select("id", "distance", "context")


def detail_similar(spark: SparkSession, sf_dir: str, anchor: int = 5, k: int = 5) -> DataFrame:
    """Nearest other items of an item: least distance by item."""
    df = embedded(spark, sf_dir)
    row = df.where(F.col("id") == anchor).agg(F.first("vector").alias("q"))
    near = df.where(F.col("id") != anchor).crossJoin(F.broadcast(row)).groupBy("id").agg(F.min(F.round(1 - vectors.cosine(F.col("vector"), F.col("q")), 6)).alias("distance"))  # one row
    return near.orderBy("distance", "id").limit(k)


def item_detail(spark: SparkSession, sf_dir: str, item: int) -> dict[str, DataFrame]:
    """The sections of an item's page: neighbours by lineage and by vector, and the timeline of a kept item, or alerts and history of any other."""
    own = lambda df: df.where(F.col("item_id") == item)
    out = {"predecessors": own(reads.detail_edges(spark, sf_dir, "pred")), "successors": own(reads.detail_edges(spark, sf_dir, "succ")), "similar": detail_similar(spark, sf_dir, item)}
    kept = T.assets(spark, sf_dir).where((F.col("tech_id") == item) & (F.col("status") == "Keep"))
    if kept.isEmpty():
        return out | {"alerts": reads.detail_log(spark, sf_dir, item, alerts=True), "history": reads.detail_log(spark, sf_dir, item, alerts=False)}
    return out | {"timeline": reads.timeline(spark, sf_dir, item)}


def similar_pairs(spark: SparkSession, sf_dir: str, threshold: float = PAIR) -> DataFrame:
    """All pairs a < b above a cosine."""
    df = embedded(spark, sf_dir)
    return vectors.similar_pairs(df, df, threshold, same=True).select("a", "b", F.round("cosine", 6).alias("cosine"))


def corroboration_counts(spark: SparkSession, sf_dir: str, threshold: float = NEAR, days: int = 7) -> DataFrame:
    """For each item of the window: how many other domains hold a similar item of the window."""
    window = slim_items(spark, sf_dir).where(F.col("created_s") >= AS_OF - days * DAY).select("id", urls.domain(F.col("source_url")).alias("domain"))
    df = embedded(spark, sf_dir).join(window, "id")
    pairs = vectors.similar_pairs(df.select("id", "vector"), df.select("id", "vector"), threshold, same=True)
    both = pairs.select("a", "b").union(pairs.select("b", "a"))
    domains = both.join(window.select(F.col("id").alias("a"), F.col("domain").alias("own")), "a").join(window.select(F.col("id").alias("b"), "domain"), "b").where("own <> domain")
    counts = domains.groupBy(F.col("a").alias("id")).agg(F.count_distinct("domain").alias("n"))
    return df.select("id").join(counts, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("corroboration"))


def corroboration_update(spark: SparkSession, sf_dir: str, threshold: float = NEAR) -> DataFrame:
    """Items whose count changes, with the new count; trust is made anew only where there is a rubric."""
    new = corroboration_counts(spark, sf_dir, threshold)
    old = T.items(spark, sf_dir, "id", "source_url", *T.RUBRIC, "corroboration_count")
    df = old.join(new, "id").where(F.col("corroboration") != F.coalesce("corroboration_count", F.lit(0)))
    trust = scores.item_trust(urls.domain(F.col("source_url")))
    return df.select("id", F.col("corroboration_count").alias("old_count"), "corroboration", F.col("corroboration").alias("new_count"), *[c for c in old.columns if c not in ("id", "corroboration_count")]).withColumn("corroboration_count", F.col("new_count")).select("id", "old_count", "new_count", F.round(trust, 6).alias("new_trust"))


def kept_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each kept item was kept: its last Keep row, else when the asset was made."""
    last = T.history(spark, sf_dir).where("changed_to = 'Keep'").groupBy("asset_id").agg(F.max("changed_s").alias("last_s"))
    return T.assets(spark, sf_dir).where("status = 'Keep'").join(last, "asset_id", "left").select("tech_id", F.coalesce("last_s", "asset_created_s").alias("kept_s"))


def decays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, weight) of kept items."""
    age = (F.lit(AS_OF) - F.col("kept_s")) / 3600
    return kept_at(spark, sf_dir).select(F.col("tech_id").alias("id"), scores.recency_decay(age).alias("weight"))


def profile_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dim, value): the decayed mean of kept vectors, less a share of the mean of passed ones. No kept item: no rows."""
    kept = vectors.elements(embedded(spark, sf_dir).join(decays(spark, sf_dir), "id"), ["weight"], "vector")
    mean = kept.groupBy("dim").agg(F.coalesce(F.try_divide(F.sum(F.col("weight") * F.col("value")), F.sum("weight")), F.lit(0.0)).alias("keep"))
    gone = T.assets(spark, sf_dir).where("status = 'Archived'").select(F.col("tech_id").alias("id"))
    passed = vectors.elements(embedded(spark, sf_dir).join(gone, "id", "left_semi"), [], "vector").groupBy("dim").agg(F.avg("value").alias("passed"))
    return mean.join(passed, "dim", "left").select("dim", (F.col("keep") - scores.SETTINGS.pass_weight * F.coalesce("passed", F.lit(0.0))).alias("value"))


def profile_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: the sum of decays of kept items with a vector, 1 at most."""
    df = decays(spark, sf_dir).join(embedded(spark, sf_dir).select("id"), "id", "left_semi")
    return df.agg(F.least(F.lit(1.0), F.coalesce(F.sum("weight"), F.lit(0.0))).alias("confidence"))


def feed_scores(spark: SparkSession, sf_dir: str, topics: tuple[str, ...] = ("the", "licen")) -> DataFrame:
    """Every item's score. The profile term is left out for items with an asset, without vector, or without a profile."""
    items = T.items(spark, sf_dir, "id", "title", "source_url", "eff_s", *T.RUBRIC, "corroboration_count", "embedding").withColumn("trust", scores.item_trust(urls.domain(F.col("source_url"))))
    items = items.join(T.assets(spark, sf_dir).select(F.col("tech_id").alias("id"), "status"), "id", "left")
    profile = profile_vector(spark, sf_dir).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "value"))), lambda x: x["value"]).alias("profile"))  # one vector
    one = profile.crossJoin(profile_confidence(spark, sf_dir))
    df = items.crossJoin(F.broadcast(one))
    age = (F.lit(AS_OF) - F.col("eff_s")) / 3600
    similar = F.when(F.col("status").isNull() & F.col("embedding").isNotNull() & (F.size("profile") > 0), vectors.cosine(F.col("embedding"), F.col("profile")) * F.col("confidence")).otherwise(0.0)
    hay = F.lower("title")
    hit = F.exists(F.lit(list(topics)), lambda t: F.contains(hay, t)) if topics else F.lit(False)
    s = scores.SETTINGS
    score = s.weight_recency * scores.recency_decay(age) + s.weight_profile * similar + s.weight_trust * F.coalesce("trust", F.lit(0.0)) + s.weight_trending * scores.trending_score(F.col("corroboration_count")) + F.when(hit, s.interest_bonus).otherwise(0.0)
    return df.select("id", F.round(score, 6).alias("score"))


def briefing_pool(spark: SparkSession, sf_dir: str, days: int = 7, size: int = 30) -> DataFrame:
    """The size most trusted items of each category in the closed window."""
    w = Window.partitionBy("category").orderBy(F.col("trust").desc_nulls_last(), F.desc("eff_s"), F.desc("id"))
    df = slim_items(spark, sf_dir).where(F.col("category").isNotNull() & F.col("eff_s").between(AS_OF - days * DAY, AS_OF))
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= size).select("id", "category", "source_url", "trust", "eff_s", "place")


#: Weights of trust, topic and kept items by what there is: (topic, kept items).
BRIEFING_WEIGHTS = {(True, True): (0.4, 0.35, 0.25), (True, False): (0.65, 0.35, 0.0), (False, True): (0.75, 0.0, 0.25), (False, False): (1.0, 0.0, 0.0)}


def briefing_selected(spark: SparkSession, sf_dir: str, limit: int = 10, cap: int = 2, centroids: DataFrame | None = None, topic: list[float] | None = None, jitter: float = 0.0, seed: int = 0) -> DataFrame:
    """The pool by score, cap items of a source at most. The score weighs trust, likeness to a topic vector and to the nearest of the kept items'
    centroids (those of keep_centroids if none are given), and adds noise of up to jitter."""
    centroids = keep_centroids(spark, sf_dir) if centroids is None else centroids
    one = centroids.agg(F.collect_list("centre").alias("centres"))  # five vectors at most
    pool = briefing_pool(spark, sf_dir, size=3 * limit).join(embedded(spark, sf_dir), "id", "left").crossJoin(F.broadcast(one))
    vector, has = F.col("vector"), F.size("centres") > 0
    keep = F.when(vector.isNotNull() & has, F.array_max(F.transform("centres", lambda c: vectors.cosine(vector, c)))).otherwise(0.0)
    like = F.when(vector.isNotNull(), vectors.cosine(vector, F.lit(topic).cast("array<double>"))).otherwise(0.0) if topic else F.lit(0.0)
    weight = [F.when(has, BRIEFING_WEIGHTS[bool(topic), True][k]).otherwise(BRIEFING_WEIGHTS[bool(topic), False][k]) for k in range(3)]
    noise = jitter * (2 * F.rand(seed) - 1) if jitter else F.lit(0.0)
    score = F.round(weight[0] * F.coalesce("trust", F.lit(0.0)) + weight[1] * like + weight[2] * keep + noise, 6)
    df = pool.select("id", "category", urls.briefing_source(F.col("source_url")).alias("source"), score.alias("score"))
    by_source = Window.partitionBy("category", "source").orderBy(F.desc("score"), F.desc("id"))
    by_category = Window.partitionBy("category").orderBy(F.desc("score"), F.desc("id"))
    few = df.withColumn("k", F.row_number().over(by_source)).where(F.col("k") <= cap)
    return few.withColumn("place", F.row_number().over(by_category)).where(F.col("place") <= limit).select("id", "category", "source", "score", "place")


def briefing_by_category(spark: SparkSession, sf_dir: str, topic_item: int = 3) -> DataFrame:
    """briefing_selected with the mean of each category's kept vectors for centroids, and an item's vector for the topic."""
    kept = T.assets(spark, sf_dir).where("status = 'Keep'").select(F.col("tech_id").alias("id"))
    df = embedded(spark, sf_dir).join(kept, "id", "left_semi").join(T.items(spark, sf_dir, "id", "category").where("category IS NOT NULL"), "id")
    means = vectors.elements(df, ["category"], "vector").groupBy("category", "dim").agg(F.avg("value").alias("value"))
    centres = means.groupBy("category").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "value"))), lambda x: x["value"]).alias("centre"))  # one vector each
    topic = embedded(spark, sf_dir).where(F.col("id") == topic_item).first()
    return briefing_selected(spark, sf_dir, centroids=centres, topic=topic and [float(x) for x in topic.vector])


def signal_matches(spark: SparkSession, sf_dir: str, threshold: float = PAIR) -> DataFrame:
    """(asset, item) pairs of kept items and others above a cosine that haven't been announced yet."""
    kept = T.assets(spark, sf_dir).where("status = 'Keep'").select("asset_id", F.col("tech_id").alias("id"))
    all_ = embedded(spark, sf_dir)
    pairs = vectors.similar_pairs(all_.join(kept, "id", "left_semi"), all_, threshold).where("a <> b")
    found = pairs.join(kept.select("asset_id", F.col("id").alias("a")), "a").select("asset_id", F.col("a").alias("tech_id"), F.col("b").alias("matched_id"), F.round("cosine", 6).alias("cosine"))
    done = T.history(spark, sf_dir).where("changed_to = 'signal_matched'").select("asset_id", F.col("changed_from").alias("m"))
    return found.join(done, (found["asset_id"] == done["asset_id"]) & (found["matched_id"].cast("string") == done["m"]), "left_anti")


def succession_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The earliest edge from each kept item to each successor that hasn't been announced; loops left out. Rows of the
    old form ('Keep' in changed_from) announce nothing in particular."""
    kept = T.assets(spark, sf_dir).where("status = 'Keep'").select("asset_id", F.col("tech_id").alias("pred"))
    edges = T.succession(spark, sf_dir).where("pred <> succ").join(kept, "pred")
    done = T.history(spark, sf_dir).where("changed_to = 'succession_alerted'").select("asset_id", F.col("changed_from").alias("m"))
    open_ = edges.join(done, (edges["asset_id"] == done["asset_id"]) & (edges["succ"].cast("string") == done["m"]), "left_anti")
    return open_.groupBy("asset_id", "succ").agg(F.min(F.struct("edge_s", "pred", "relation")).alias("m")).select("asset_id", "succ", F.col("m.pred").alias("pred"), F.col("m.relation").alias("relation"), F.col("m.edge_s").alias("edge_s"))


def keep_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k-means centres of the kept vectors, k by their number (1, 2, 3 or n // 6 up to 5), seeded."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    kept = T.assets(spark, sf_dir).where("status = 'Keep'").select(F.col("tech_id").alias("id"))
    df = embedded(spark, sf_dir).join(kept, "id", "left_semi").select(array_to_vector("vector").alias("features"))
    n = df.count()
    k = 1 if n < 3 else 2 if n < 9 else 3 if n < 18 else min(5, n // 6)
    schema = "cluster int, centre array<double>"
    if not n:
        return spark.createDataFrame([], schema)
    centres = KMeans(k=k, seed=1, maxIter=20, tol=1e-6).fit(df).clusterCenters()  # five vectors at most
    return spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)], schema)
