"""The staged batch: queue, filters, model answers, gates, saves and the run's counters.

What models answer is a column of the input; the rules about what becomes of an answer are here. Each stage is a projection of the one
before, so that a batch is one pass over its rows; the queue is read and written as tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import scores, urls
from lodestar.functions import text as X
from lodestar.operators import ingest
from lodestar.sources import tables as T

#: Characters of a text that a model sees, and of a summary that are kept.
SEEN, SUMMARY = 2000, 500
CATEGORIES = ["Mainstream", "Alpha"]
BALANCE = ["balanced", "mixed", "unsupported"]
MARKETING = ["low", "medium", "high"]


def states(items: DataFrame) -> DataFrame:
    """Items (source_url, raw_content, image_url, published_s, source_category) as states before the first stage."""
    none = lambda kind: F.lit(None).cast(kind)
    return items.withColumns({
        "raw_text": F.coalesce("raw_content", F.lit("")), "source_url": F.trim(F.coalesce("source_url", F.lit(""))), "is_valid": F.lit(False), "trust_score": none("double"), "summary": none("string"), "category": none("string"),
        "triage_error": none("string"), "saved": F.lit(False), "genealogy_skipped": F.lit(False), "genealogy_skip_reason": none("string"),
    }).drop("raw_content")


def _kind(v: Column, name: str) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant")), F.lit("VOID"))


def _string(v: Column, name: str) -> Column:
    """A string field without white space at its ends; null for other types and for words that say so."""
    s = X.stripped(F.when(_kind(v, name) == "STRING", F.try_variant_get(v, f"$.{name}", "string")))
    return F.when(~F.lower(s).isin("", "null", "none"), s)


def _is_true(v: Column, name: str) -> Column:
    return (_kind(v, name) == "BOOLEAN") & F.coalesce(F.try_variant_get(v, f"$.{name}", "boolean"), F.lit(False))


def _one_of(v: Column, name: str, words: list[str], otherwise: str) -> Column:
    s = F.lower(_string(v, name))
    return F.when(s.isin(words), s).otherwise(otherwise)


def rubric_of(df: DataFrame, answer: str) -> DataFrame:
    """df with the five answers of the rubric from a model's answer, the worst where there is none, and readable: whether it has JSON of the right form."""
    v = F.col("_v")
    df = df.withColumn("_v", F.try_parse_json(X.json_slice(F.coalesce(F.col(answer), F.lit("")))))
    relevant = (_kind(v, "is_relevant") == "BOOLEAN") | ~F.coalesce(F.schema_of_variant(v), F.lit("")).contains("is_relevant: ")
    return df.withColumns({
        "readable": F.coalesce((_kind(v, "is_valid") == "BOOLEAN") & (_kind(v, "reason") == "STRING") & relevant, F.lit(False)),
        "primary_source": _is_true(v, "is_primary_source"), "has_links": _is_true(v, "has_evidence_links"), "has_numbers": _is_true(v, "has_concrete_numbers"),
        "balance": _one_of(v, "claim_evidence_balance", BALANCE, "unsupported"), "marketing": _one_of(v, "marketing_intensity", MARKETING, "high"),
    })


def triaged(df: DataFrame, answer: str = "triage_answer", error: str = "triage_failure", topics: tuple[str, ...] = (), exclusions: tuple[str, ...] = ()) -> DataFrame:
    """States after triage. A failure of the model (error not null) is kept for another try. An answer without JSON, or whose is_valid isn't a
    boolean or reason no string, makes a state invalid. With topics, what isn't relevant loses all results; a hit of an excluded term in the text seen or in the summary
    leaves trust 0; all others get trust from the rubric, and summary and category if valid."""
    v = F.col("_v")
    df = rubric_of(df, answer)
    df = df.withColumns({
        "_failed": F.col(error).isNotNull(), "_read": F.col("readable") & F.col(error).isNull(),
        "_summary": F.substring(_string(v, "summary"), 1, SUMMARY), "_category": F.coalesce(*[F.when(F.lower(_string(v, "category")) == c.lower(), c) for c in CATEGORIES], F.lit("Alpha")),
        "_dull": F.lit(bool(topics)) & (_kind(v, "is_relevant") == "BOOLEAN") & ~_is_true(v, "is_relevant"), "_valid": _is_true(v, "is_valid"),
    })
    seen = F.concat(F.substring("raw_text", 1, SEEN), F.lit(" "), F.coalesce("_summary", F.lit("")))
    hit = F.col("_read") & (F.size(X.term_hits(seen, list(exclusions))) > 0) if exclusions else F.lit(False)
    df = df.withColumns({"_judged": F.col("_read") & ~F.col("_dull"), "_hit": hit})
    rubric = scores.score_rubric(*[F.col(c) for c in ("primary_source", "has_links", "has_numbers", "balance", "marketing")])
    trust = scores.synthesize_trust(rubric, scores.source_prior(urls.domain(F.col("source_url"))), F.lit(0.0))
    good = F.col("_judged") & ~F.col("_hit") & F.col("_valid")
    out = {
        "is_valid": good, "trust_score": F.when(F.col("_judged"), F.when(F.col("_hit"), 0.0).otherwise(trust)), "summary": F.when(good, F.col("_summary")), "category": F.when(good, F.col("_category")),
        "triage_error": F.when(F.col("_failed"), F.coalesce(F.nullif(F.col(error), F.lit("")), F.lit("error"))),
    }
    df = df.withColumns(out).withColumns({c: F.when(F.col("_judged"), F.col(c)) for c in ("primary_source", "has_links", "has_numbers", "balance", "marketing")})
    return df.drop(*[c for c in df.columns if c.startswith("_")], "readable", answer, error)


def digested(df: DataFrame, answer: str = "digest_answer", least: int = 1000, least_out: int = 150) -> DataFrame:
    """States with a digest: of valid ones with enough text, the answer without thoughts, if it is long enough and not the summary again."""
    text = X.drop_think(F.col(answer))
    good = F.col("is_valid") & (F.char_length(X.stripped(F.col("raw_text"))) >= least) & ingest.digest_accepted(text, F.col("summary"), least_out)
    return df.withColumn("digest", F.when(good, text)).drop(answer)


def gated(df: DataFrame, embedded: DataFrame, least_items: int = 50, least_trust: float = 0.4) -> DataFrame:
    """States that the lineage stage skips: all valid ones before least_items items have vectors (embedded: one row, n), then those of low trust; null trust passes."""
    df = df.crossJoin(F.broadcast(embedded.select(F.col("n").alias("_n"))))  # one row
    cold = F.col("is_valid") & (F.col("_n") < least_items)
    low = F.col("is_valid") & ~cold & (F.col("trust_score") < least_trust)
    reason = F.when(cold, "cold_start").when(F.coalesce(low, F.lit(False)), "low_trust")
    return df.withColumns({"genealogy_skip_reason": reason, "genealogy_skipped": reason.isNotNull()}).drop("_n")


def with_lineage(df: DataFrame, answer: str = "lineage_answer", related: str = "n_related") -> DataFrame:
    """States with succession, struct<replace_target_id, relation_type, reason>: of valid ones that weren't skipped and have related items. Null for answers
    without JSON or with a missing field or a wrong type; words for null in the target are null."""
    v = F.col("_v")
    df = df.withColumn("_v", F.try_parse_json(X.json_slice(F.coalesce(F.col(answer), F.lit("")))))
    kinds = F.coalesce(F.schema_of_variant(v), F.lit(""))
    there = lambda name: kinds.rlike(rf"[<, ]{name}: (?:STRING|VOID)")
    whole = there("replace_target_id") & there("relation_type") & (_kind(v, "reason") == "STRING")
    text = lambda name: F.try_variant_get(v, f"$.{name}", "string")
    target = F.when(~F.lower(X.stripped(text("replace_target_id"))).isin("", "null", "none"), text("replace_target_id"))
    made = F.struct(target.alias("replace_target_id"), text("relation_type").alias("relation_type"), text("reason").alias("reason"))
    return df.withColumn("succession", F.when(F.col("is_valid") & ~F.col("genealogy_skipped") & (F.col(related) > 0) & whole, made)).drop("_v", answer)


def saves(df: DataFrame, known: DataFrame, failed: str = "save_failed") -> DataFrame:
    """States with saved, whether the save stage went through (not tried without address or after a failure in triage), and inserted, whether it adds an
    item: a valid state whose address is not known (source_url) yet. The category of an item that has none is Alpha."""
    there = known.select("source_url").distinct().withColumn("_there", F.lit(True))
    df = df.join(there, "source_url", "left")
    saved = (F.col("source_url") != "") & F.col("triage_error").isNull() & ~F.col(failed)
    df = df.withColumns({"saved": saved, "inserted": saved & F.col("is_valid") & F.col("_there").isNull()}).drop("_there", failed)
    return df.withColumns({"category": F.when(F.col("inserted"), F.coalesce("category", F.lit("Alpha"))).otherwise(F.col("category")), "title": F.when(F.col("inserted"), T.first_line(F.col("raw_text")))})


def retained(df: DataFrame) -> DataFrame:
    """States that stay in the queue for another run: valid ones that weren't saved, and failures of triage."""
    return df.where((F.col("source_url") != "") & ((F.col("is_valid") & ~F.col("saved")) | F.col("triage_error").isNotNull()))


def run_summary(selected: DataFrame, passed: DataFrame, done: DataFrame, waiting: DataFrame) -> DataFrame:
    """The counters of a run in one row: rows selected from the queue, those that pass the preflight, states at the end, and rows of the whole queue."""
    one = done.agg(
        F.count_if("is_valid").alias("triage_pass"), F.count_if("saved").alias("saved_new"), F.count_if("inserted").alias("inserted"),
        F.count_if(F.col("genealogy_skip_reason") == "cold_start").alias("genealogy_skipped"), F.count_if(F.col("genealogy_skip_reason") == "low_trust").alias("trust_skipped"),
    )
    taken = selected.agg(F.count("*").alias("queue_selected"))
    kept = retained(done).agg(F.count("*").alias("kept"))
    all_ = waiting.agg(F.count("*").alias("n"))
    df = one.crossJoin(taken).crossJoin(passed.agg(F.count("*").alias("passed"))).crossJoin(kept).crossJoin(all_)  # rows of one aggregate each
    rest = F.col("n") - F.col("queue_selected") + F.col("kept")
    return df.select("queue_selected", (F.col("queue_selected") - F.col("passed")).alias("preflight_filtered"), "triage_pass", "saved_new", "inserted", "genealogy_skipped", "trust_skipped", rest.alias("queue_remaining"))


def summary_line(summary: DataFrame, tallies: DataFrame) -> DataFrame:
    """(sources, queue): how many items each source gave, the two leading ones by their own names first, and what was taken of the queue."""
    label = F.when(F.col("source") == "github_trending", "GitHub").when(F.col("source") == "hackernews", "HN").otherwise(F.col("source"))
    rank = F.when(F.col("source") == "github_trending", 0).when(F.col("source") == "hackernews", 1).otherwise(2)
    mix = tallies.agg(F.array_sort(F.collect_list(F.struct(rank.alias("rank"), "source", F.concat(label, F.lit(": "), F.col("n").cast("string")).alias("said")))).alias("m"))  # a row per source
    total = F.col("queue_selected") + F.col("queue_remaining")
    part = F.col("queue_selected").cast("string")
    queue = F.when(total > 0, F.concat(part, F.lit(" / "), total.cast("string"), F.lit(" ("), F.col("queue_remaining").cast("string"), F.lit(")"))).otherwise(part)
    return summary.crossJoin(mix).select(F.concat_ws(", ", F.transform("m", lambda x: x["said"])).alias("sources"), queue.alias("queue"))


# ---------------------------------------------------------------- over the driver's tables


def queue_items(spark: SparkSession, sf_dir: str, limit: int = 150) -> DataFrame:
    """The next batch of the queue with the texts of the pages' documents, and model answers made from the ids."""
    i = F.col("queue_id")
    text = T.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("queue_id"), F.col("text").alias("raw_content"))
    batch = ingest.queue_batch(spark, sf_dir, limit).join(text, "queue_id", "left")
    answer = (
        F.when(i % 10 == 7, "no braces here").when(i % 10 == 8, '{"is_valid": "yes", "reason": "r"}')
        .otherwise(F.concat(
            F.lit('Sure: {"is_valid": '), F.when(i % 5 == 1, "false").otherwise("true"), F.lit(', "reason": "r", "summary": "'), F.when(i % 4 == 3, " None ").otherwise(F.concat(F.lit(" sum "), i.cast("string"))),
            F.lit('", "category": "'), F.when(i % 3 == 0, "MAINSTREAM").when(i % 3 == 1, "other").otherwise("alpha"), F.lit('", "is_relevant": '), F.when(i % 9 == 4, "false").otherwise("true"),
            F.lit(', "is_primary_source": '), F.when(i % 2 == 0, "true").otherwise('"true"'), F.lit(', "has_evidence_links": true, "claim_evidence_balance": " Mixed ", "marketing_intensity": '), F.when(i % 2 == 0, '"LOW"').otherwise("5"), F.lit("} done"),
        ))
    )
    digest = F.concat(F.lit("<think>a\nb</think> "), F.repeat(F.lit("digest "), (i % 40).cast("int")))
    lineage = F.when(i % 4 == 0, '{"replace_target_id": " null", "relation_type": "Enhance", "reason": "r"}').when(i % 4 == 1, F.concat(F.lit('x {"replace_target_id": "'), i.cast("string"), F.lit('", "relation_type": null, "reason": "r"} y'))).otherwise('{"relation_type": "Fork", "reason": "r"}')
    return batch.withColumns({
        "triage_answer": answer, "triage_failure": F.when(i % 13 == 5, F.when(i % 2 == 0, "").otherwise("timeout")), "digest_answer": digest, "lineage_answer": lineage, "n_related": i % 3, "save_failed": i % 17 == 3,
        "source_url": F.when(i % 19 != 0, F.col("source_url")),
    })


def run_batch(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows selected, those that pass the preflight and have an address, and their states at the end."""
    selected = queue_items(spark, sf_dir)
    passed = selected.where(~X.preflight_reject(F.coalesce("raw_content", F.lit(""))))
    embedded = T.read(spark, sf_dir, "embeddings").where(F.col("embedding").isNotNull()).agg(F.count("*").alias("n"))
    start = states(passed.where(F.trim(F.coalesce("source_url", F.lit(""))) != ""))
    judged = digested(triaged(start, topics=("any",), exclusions=("license", "SUM 12")))
    done = saves(with_lineage(gated(judged, embedded)), T.items(spark, sf_dir, "source_url"))
    return selected, passed, done


def batch_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The states of a batch at its end."""
    df = run_batch(spark, sf_dir)[2]
    return df.select(
        "queue_id", "is_valid", F.round("trust_score", 6).alias("trust_score"), "summary", "category", "balance", "marketing", "triage_error", F.char_length("digest").alias("digest_chars"), "genealogy_skip_reason",
        F.col("succession.replace_target_id").alias("target"), F.col("succession").isNotNull().alias("has_succession"), "saved", "inserted",
    )


def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counters of that batch."""
    return run_summary(*run_batch(spark, sf_dir), T.crawl_queue(spark, sf_dir))


def batch_retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queue after that batch: rows not taken, and rows for another try."""
    selected, _, done = run_batch(spark, sf_dir)
    gone = selected.select("queue_id").join(retained(done).select("queue_id"), "queue_id", "left_anti")
    return T.crawl_queue(spark, sf_dir).join(gone, "queue_id", "left_anti").select("queue_id", "source_url")


_TRUST = f"0.6::DOUBLE * (CASE WHEN q % 2 = 0 THEN 0.25::DOUBLE ELSE 0 END + 0.2::DOUBLE + 0.1::DOUBLE + CASE WHEN q % 2 = 0 THEN 0.15::DOUBLE ELSE 0 END) + 0.2::DOUBLE * ({scores.PRIOR_SQL})"
VIEWS_SQL = f"""{T.VIEWS_SQL}, chosen AS (SELECT queue_id AS q, source_url FROM crawl_queue ORDER BY published_s DESC NULLS LAST, queued_s, queue_id LIMIT 150),
held AS (SELECT q, CASE WHEN q % 19 <> 0 THEN source_url END AS source_url, coalesce(d.text, '') AS text FROM chosen LEFT JOIN documents d ON d.doc_id = q),
passed AS (SELECT * FROM held WHERE NOT regexp_matches(left(text, 2000), '\\b(?:{"|".join(X.REJECTED).replace("'", "''")})\\b', 'i')),
read AS (SELECT *, q % 13 = 5 AS failed, q % 13 <> 5 AND q % 10 NOT IN (7, 8) AS ok, CASE WHEN q % 4 <> 3 THEN 'sum ' || q END AS said FROM passed WHERE source_url IS NOT NULL),
judged AS (SELECT *, ok AND q % 9 <> 4 AS judged, contains(lower(left(text, 2000) || ' ' || coalesce(said, '')), 'license') OR contains(lower(left(text, 2000) || ' ' || coalesce(said, '')), 'sum 12') AS hit FROM read),
valid AS (SELECT *, judged AND NOT hit AND q % 5 <> 1 AS is_valid, CASE WHEN judged THEN CASE WHEN hit THEN 0 ELSE {_TRUST} END END AS trust FROM judged),
gates AS (SELECT *, CASE WHEN is_valid THEN CASE WHEN (SELECT count(*) FROM embeddings WHERE embedding IS NOT NULL) < 50 THEN 'cold_start' WHEN trust < 0.4::DOUBLE THEN 'low_trust' END END AS reason,
  NOT failed AND q % 17 <> 3 AS saved FROM valid),
done AS (SELECT *, saved AND is_valid AND source_url NOT IN (SELECT source_url FROM items) AS inserted, length(trim(repeat('digest ', (q % 40)::INTEGER))) AS digest_n FROM gates)
"""
QUERIES = {"batch_states": batch_states, "batch_summary": batch_summary, "batch_retained": batch_retained}
ORACLE_SQL = {
    "batch_states": f"""{VIEWS_SQL} SELECT q AS queue_id, is_valid, round(trust, 6) AS trust_score, CASE WHEN is_valid THEN said END AS summary, CASE WHEN is_valid THEN CASE WHEN q % 3 = 0 THEN 'Mainstream' ELSE 'Alpha' END END AS category,
      CASE WHEN judged THEN 'mixed' END AS balance, CASE WHEN judged THEN CASE WHEN q % 2 = 0 THEN 'low' ELSE 'high' END END AS marketing, CASE WHEN failed THEN CASE WHEN q % 2 = 0 THEN 'error' ELSE 'timeout' END END AS triage_error,
      CASE WHEN is_valid AND length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) >= 1000 AND digest_n >= 150 THEN digest_n END::INTEGER AS digest_chars, reason AS genealogy_skip_reason,
      CASE WHEN is_valid AND reason IS NULL AND q % 3 > 0 AND q % 4 = 1 THEN q::VARCHAR END AS target, is_valid AND reason IS NULL AND q % 3 > 0 AND q % 4 < 2 AS has_succession, saved, inserted FROM done""",
    "batch_summary": f"""{VIEWS_SQL} SELECT (SELECT count(*) FROM chosen) AS queue_selected, (SELECT count(*) FROM chosen) - (SELECT count(*) FROM passed) AS preflight_filtered, count(*) FILTER (WHERE is_valid) AS triage_pass,
      count(*) FILTER (WHERE saved) AS saved_new, count(*) FILTER (WHERE inserted) AS inserted, count(*) FILTER (WHERE reason = 'cold_start') AS genealogy_skipped, count(*) FILTER (WHERE reason = 'low_trust') AS trust_skipped,
      (SELECT count(*) FROM crawl_queue) - (SELECT count(*) FROM chosen) + count(*) FILTER (WHERE (is_valid AND NOT saved) OR failed) AS queue_remaining FROM done""",
    "batch_retained": f"""{VIEWS_SQL} SELECT queue_id, source_url FROM crawl_queue WHERE queue_id NOT IN (SELECT q FROM chosen) OR queue_id IN (SELECT q FROM done WHERE (is_valid AND NOT saved) OR failed)""",
}
