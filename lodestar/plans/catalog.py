"""All queries by name, with the DuckDB SQL that checks them where SQL can say the same."""

from __future__ import annotations

from functools import partial

from lodestar.functions.scores import DOMAIN_SQL, NETLOC_SQL, PRIOR_SQL, TRUST_SQL
from lodestar.functions.text import REJECTED
from lodestar.operators import batch, collect, ingest, names, pages, ranking, reads, texts
from lodestar.plans import scale
from lodestar.sources import tables as T
from lodestar.sources.tables import AS_OF, DAY, VIEWS_SQL, WEEK

#: A cursor for the second pages: behind this time and id.
CURSOR = (AS_OF - 5 * DAY, 10**9)

QUERIES = {
    "stats_summary": reads.stats_summary,
    "source_mix": reads.source_mix,
    "feed_latest": partial(reads.feed, sort="latest"),
    "feed_latest_page2": partial(reads.feed, sort="latest", cursor=("latest", *CURSOR)),
    "feed_latest_alpha": partial(reads.feed, sort="latest", category="Alpha"),
    "feed_recommended": reads.feed,
    "feed_recommended_page2": partial(reads.feed, cursor=("recommended", 0.3, *CURSOR)),
    "feed_recommended_nulltail": partial(reads.feed, cursor=("recommended", None, *CURSOR)),
    "feed_hero": reads.feed_hero,
    "feed_diverse_page": pages.feed_diverse_page,
    "feed_pinned_page": pages.feed_pinned_page,
    "feed_new_count": lambda s, d: T.items(s, d, "eff_s").where(f"eff_s > {AS_OF - DAY}").groupBy().count().withColumnRenamed("count", "n"),
    "feed_poll_baseline": lambda s, d: T.items(s, d, "id", "eff_s").orderBy("eff_s", "id", ascending=False).limit(1).select("id", "eff_s"),
    "portfolio_recency": reads.portfolio,
    "portfolio_trust": partial(reads.portfolio, sort="trust"),
    "portfolio_page2": partial(reads.portfolio, cursor=(None, AS_OF - 10 * DAY, 10**9)),
    "portfolio_trust_page2": partial(reads.portfolio, sort="trust", cursor=(0.7, AS_OF - 10 * DAY, 10**9)),
    "portfolio_trust_nulltail": partial(reads.portfolio, sort="trust", cursor=(None, AS_OF - 10 * DAY, 10**9)),
    "portfolio_groups": reads.portfolio_groups,
    "user_portfolio": reads.user_portfolio,
    "user_portfolio_trust": partial(reads.user_portfolio, sort="trust", category="Alpha"),
    "lineage_counts": reads.lineage_counts,
    "weekly_report": reads.weekly_report,
    "activity_ticker": reads.activity_ticker,
    "timeline_all": reads.timeline_all,
    "timeline_item": partial(reads.timeline, item=20, limit=12),
    "inferred_handoff": reads.inferred_handoff,
    "replace_successors": reads.replace_successors,
    "detail_predecessors": partial(reads.detail_edges, towards="pred"),
    "detail_successors": partial(reads.detail_edges, towards="succ"),
    "detail_history": partial(reads.detail_log, viewed=1, alerts=False),
    "detail_alerts": partial(reads.detail_log, viewed=1, alerts=True),
    "detail_similar": ranking.detail_similar,
    "signals_rolling_7d": reads.rolling_signals,
    "vector_search_topk": ranking.search_topk,
    "vector_context_topn": ranking.context_topn,
    "similar_pairs": ranking.similar_pairs,
    "corroboration_counts": ranking.corroboration_counts,
    "corroboration_update": ranking.corroboration_update,
    "signal_matches": ranking.signal_matches,
    "succession_alerts": ranking.succession_alerts,
    "keep_profile_vector": lambda s, d: ranking.profile_vector(s, d).selectExpr("dim", "round(value, 6) AS value"),
    "profile_confidence": lambda s, d: ranking.profile_confidence(s, d).selectExpr("round(confidence, 6) AS confidence"),
    "kept_at": ranking.kept_at,
    "recency_decay": lambda s, d: ranking.decays(s, d).selectExpr("id", "round(weight, 6) AS weight"),
    "trust_scores": lambda s, d: reads.slim_items(s, d).selectExpr("id", "round(trust, 6) AS trust"),
    "trending_scores": lambda s, d: reads.slim_items(s, d).select("id", reads.F.round(reads.scores.trending_score(reads.F.col("corroboration_count")), 6).alias("trending")),
    "feed_scores": ranking.feed_scores,
    "briefing_pool": ranking.briefing_pool,
    "briefing_selected": ranking.briefing_by_category,
    "keep_centroids": ranking.keep_centroids,
    "dedup_urls": ingest.dedup_urls,
    "queue_batch": ingest.queue_batch,
    "queue_retained": ingest.queue_retained,
    "queue_depth": ingest.queue_depth,
    "queue_without_batch": ingest.queue_without_batch,
    "asset_toggles": ingest.asset_toggles,
    "briefed_stamp": ingest.briefed,
    "favicon_rows": ingest.favicon_rows,
    "safe_addresses": ingest.safe_addresses,
    "asset_keep_latest": ingest.asset_keep_latest,
    "asset_transitions": ingest.asset_transitions,
    "asset_requests": ingest.asset_requests,
    "handoff_outcomes": ingest.handoff_outcomes,
    "event_batch_valid": ingest.event_batch_valid,
    "favicon_backfill": ingest.favicon_backfill,
    "digest_candidates": ingest.digest_candidates,
    "digest_backfill": ingest.digest_backfill,
    "title_backfill": ingest.title_backfill,
    "trust_backfill": ingest.trust_backfill,
    "run_log": texts.run_log,
    "pruned_files": texts.pruned_files,
    "add_url_status": ingest.add_url_status,
    "resolve_events": ingest.resolve_events,
    "event_documents": ingest.event_evidence,
    "event_entities": ingest.entities_by_event,
    "events_for_entity": partial(ingest.events_for_entity, name=""),
    "feed_event_counts": ingest.feed_event_counts,
    "preflight_reject": texts.preflight,
    "exclusion_hits": texts.exclusion_hits,
    "interest_hits": texts.interest_hits,
    "title_from_content": texts.title_from_content,
    "clean_titles": texts.clean_titles,
    "page_text": texts.page_text,
    "domains_all": texts.domains_all,
    "arxiv_canonical": texts.arxiv_addresses,
    "entity_key": texts.entity_keys,
    "canonical_names": texts.canonical_names,
    "simhash_docs": texts.simhash_docs,
    "near_dup_pairs": texts.simhash_groups,
    "simhash_docs_md5": partial(texts.simhash_docs, md5=True),
    "near_dup_pairs_md5": partial(texts.simhash_groups, md5=True),
    "item_by_id": lambda s, d: T.items(s, d, "id", "title", "source_url", "category", "created_s").where("id = 7"),
    "item_by_url": lambda s, d: T.items(s, d, "id", "source_url").where("source_url = 'https://github.com/own23/repo23'").select("id"),
    "vector_search_keep": partial(ranking.search_topk, category="alpha", status="keep"),
    "exact_dup_groups": texts.exact_dup_groups,
    "entity_doc_freq": texts.entity_doc_freq,
    "entity_names": names.entity_names,
    **batch.QUERIES,
    **collect.QUERIES,
    **scale.QUERIES,
}

_AGE = f"(({AS_OF} - eff_s) / 3600.0)"
_CARD = "id, title, category, eff_s, trust, feed_score, status"
_SCORED = f"""{VIEWS_SQL}, slim AS (SELECT *, {TRUST_SQL} AS trust FROM items),
scored AS (SELECT s.*, a.status, CASE WHEN id % 9 <> 8 THEN round(0.35::DOUBLE * CASE WHEN {_AGE} < 0 THEN 0 ELSE pow(0.5::DOUBLE, {_AGE} / 48.0) END
  + 0.15::DOUBLE * coalesce(trust, 0) + 0.15::DOUBLE * (coalesce(corroboration_count, 0) / (coalesce(corroboration_count, 0) + 1)), 6) END AS feed_score
  FROM slim s LEFT JOIN assets a ON a.tech_id = s.id)"""
#: A page spread step by step: of the band that is on (scored rows first), the domain with most rows left but the last one taken, the first seen of equals.
_SPREAD = """walk AS (
  SELECT 0 AS step, rest, avoid AS last, NULL::BIGINT AS pick FROM start
  UNION ALL
  SELECT step + 1, list_filter(rest, lambda x: x.id <> best.id), best.domain, best.id FROM (
    SELECT w.step, w.rest, (SELECT arg_min(u, (NOT u.scored, coalesce(u.domain = w.last, false), -len(list_filter(w.rest, lambda x: x.domain = u.domain AND x.scored = u.scored)), u.seen, u.place))
      FROM (SELECT unnest(w.rest) AS u)) AS best FROM walk w WHERE len(w.rest) > 0))"""
_PAGE = """front AS (SELECT id, feed_score, eff_s, row_number() OVER (ORDER BY feed_score DESC NULLS LAST, eff_s DESC, id DESC) - 1 AS place, {domain} AS domain, feed_score IS NOT NULL AS scored
  FROM scored ORDER BY feed_score DESC NULLS LAST, eff_s DESC, id DESC LIMIT 20),
rows20 AS (SELECT *, min(place) OVER (PARTITION BY domain, scored) AS seen FROM front)""".format(domain=DOMAIN_SQL)
#: Folded text by what the driver's texts hold; marks behind words and dots before names are put away while all others go.
_FOLDED = r"""folded AS (SELECT doc_id, replace(lower(text), 'ß', 'ss') AS t FROM documents),
kept AS (SELECT doc_id, t, """ + "regexp_replace(" * 5 + "regexp_replace(t, '(^|[^\\p{L}\\p{N}_.])\\.(\\p{L})', '\\1 ' || chr(57346) || '\\2', 'g')" + ", '([\\p{L}\\p{N}_\\x{E001}])#', '\\1' || chr(57345), 'g')" * 5 + r""" AS k FROM folded),
plain AS (SELECT doc_id, trim(regexp_replace(replace(replace(regexp_replace(k, '[^\p{L}\p{N}\p{M}\x{E001}\x{E002}]', ' ', 'g'), chr(57345), '#'), chr(57346), '.'), ' +', ' ', 'g')) AS p, trim(regexp_replace(t, '\s+', ' ', 'g')) AS whole FROM kept),
texts AS (SELECT doc_id, CASE WHEN p = '' THEN whole ELSE p END AS t FROM plain),
grams AS (SELECT doc_id, ('0x' || substr(md5(substr(t, spot, 4)), 1, 16))::UBIGINT AS h FROM (SELECT doc_id, t, unnest(range(1, greatest(length(t) - 3, 1) + 1)) AS spot FROM texts WHERE t <> '')),
votes AS (SELECT doc_id, """ + " + ".join(f"CASE WHEN 2 * sum((h >> {b}) & 1) > count(*) THEN {1 << b}::HUGEINT ELSE 0 END" for b in range(64)) + f""" AS v FROM grams GROUP BY doc_id),
hashes AS (SELECT d.doc_id, (CASE WHEN coalesce(v, 0) >= {1 << 63} THEN v - {1 << 64} ELSE coalesce(v, 0) END)::BIGINT AS simhash FROM documents d LEFT JOIN votes USING (doc_id))"""
_REC, _LAT = "feed_score DESC NULLS LAST, eff_s DESC, id DESC", "eff_s DESC, id DESC"
_BEHIND = f"(eff_s < {CURSOR[0]} OR (eff_s = {CURSOR[0]} AND id < {CURSOR[1]}))"
_VEC = "emb AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vector FROM embeddings WHERE embedding IS NOT NULL AND vec_id IN (SELECT doc_id FROM documents))"
_COS = "list_cosine_similarity({0}, {1})"
_PORT = f"""{_SCORED}, alerts AS (SELECT tech_id, count(*) FILTER (WHERE changed_to IN ('succession_alerted', 'signal_matched') AND changed_s >= {AS_OF - WEEK}) AS alerts_7d, max(changed_s) AS last_s FROM history GROUP BY 1),
port AS (SELECT a.tech_id, s.title, s.trust, coalesce(h.alerts_7d, 0) AS alerts_7d, coalesce(h.last_s, a.asset_created_s) AS activity_s,
  (SELECT count(*) FROM succession x WHERE x.pred = a.tech_id OR x.succ = a.tech_id) AS n_lineage, coalesce(h.alerts_7d, 0) > 0 AS active
  FROM assets a JOIN slim s ON s.id = a.tech_id LEFT JOIN alerts h ON h.tech_id = a.tech_id WHERE a.status = 'Keep')"""
_KEPT = f"""{VIEWS_SQL}, kept AS (SELECT a.tech_id, coalesce((SELECT max(changed_s) FROM history h WHERE h.asset_id = a.asset_id AND h.changed_to = 'Keep'), a.asset_created_s) AS kept_s FROM assets a WHERE status = 'Keep'),
decay AS (SELECT tech_id AS id, CASE WHEN kept_s > {AS_OF} THEN 0 ELSE pow(0.5::DOUBLE, ({AS_OF} - kept_s) / 3600.0 / 48.0) END AS weight FROM kept), {_VEC},
keep_mean AS (SELECT dim, sum(weight * value) / sum(weight) AS k FROM (SELECT weight, unnest(vector) AS value, generate_subscripts(vector, 1) - 1 AS dim FROM emb JOIN decay USING (id)) GROUP BY dim),
pass_mean AS (SELECT dim, avg(value) AS p FROM (SELECT unnest(vector) AS value, generate_subscripts(vector, 1) - 1 AS dim FROM emb WHERE id IN (SELECT tech_id FROM assets WHERE status = 'Archived')) GROUP BY dim),
profile AS (SELECT dim, k - 0.3::DOUBLE * coalesce(p, 0) AS value FROM keep_mean LEFT JOIN pass_mean USING (dim)),
confidence AS (SELECT least(1.0, coalesce(sum(weight), 0)) AS confidence FROM decay JOIN emb USING (id))"""
_CORR = f"""{VIEWS_SQL}, {_VEC}, win AS (SELECT id, {DOMAIN_SQL} AS domain, vector FROM items JOIN emb USING (id) WHERE created_s >= {AS_OF - WEEK}),
corr AS (SELECT x.id, count(DISTINCT y.domain) FILTER (WHERE y.domain <> x.domain) AS corroboration FROM win x LEFT JOIN win y ON x.id <> y.id AND {_COS.format('x.vector', 'y.vector')} > {ranking.NEAR} GROUP BY x.id)"""
_TRUST_BEHIND = f"(activity_s < {AS_OF - 10 * DAY} OR (activity_s = {AS_OF - 10 * DAY} AND tech_id < 1000000000))"
_POOL = f"""pool AS (SELECT * FROM (SELECT id, category, source_url, trust, eff_s, row_number() OVER (PARTITION BY category ORDER BY trust DESC NULLS LAST, eff_s DESC, id DESC) AS place
  FROM slim WHERE category IS NOT NULL AND eff_s BETWEEN {AS_OF - WEEK} AND {AS_OF}) WHERE place <= 30)"""
_TIMELINE = f"""{VIEWS_SQL}, kh AS (SELECT h.* FROM history h JOIN assets a USING (asset_id) WHERE a.status = 'Keep'), ke AS (SELECT x.* FROM succession x JOIN assets a ON a.tech_id = x.pred WHERE a.status = 'Keep'), line AS (
      SELECT tech_id, 'status' AS kind, changed_s AS at_s, changed_to AS detail, history_id AS ref FROM kh WHERE changed_to IN ('Keep', 'Tracking', 'Archived')
      UNION ALL SELECT tech_id, 'signal', changed_s, changed_from, history_id FROM kh WHERE changed_to = 'signal_matched' AND changed_from IN (SELECT id::VARCHAR FROM items)
      UNION ALL SELECT pred, 'succession', edge_s, relation || ':' || succ, succ FROM ke
      UNION ALL SELECT tech_id, 'succession', changed_s, 'alert:' || changed_from, history_id FROM kh WHERE changed_to = 'succession_alerted' AND NOT EXISTS (SELECT 1 FROM ke WHERE ke.pred = kh.tech_id AND ke.succ::VARCHAR = kh.changed_from))"""
_LOG = "(SELECT 1 UNION SELECT pred FROM succession WHERE pred = 1 OR succ = 1 UNION SELECT succ FROM succession WHERE pred = 1 OR succ = 1)"
_MATCH = "LEFT JOIN items m ON h.changed_to = 'signal_matched' AND m.id::VARCHAR = h.changed_from"


def _edges(own: str, other: str) -> str:
    return f"{VIEWS_SQL} SELECT x.{own} AS item_id, i.id AS other_id, i.title, x.relation, a.status FROM succession x JOIN items i ON i.id = x.{other} LEFT JOIN assets a ON a.tech_id = i.id"


ORACLE_SQL = {
    "stats_summary": f"""{VIEWS_SQL} SELECT count(*) AS total, count(category) AS valid, count(*) FILTER (WHERE category = 'Mainstream') AS mainstream, count(*) FILTER (WHERE category = 'Alpha') AS alpha,
      count(*) FILTER (WHERE status = 'Keep') AS kept, count(*) FILTER (WHERE status = 'Archived') AS passed, count(*) FILTER (WHERE status IS NULL OR status = 'Tracking') AS unclassified,
      (SELECT count(*) FROM history WHERE changed_s >= {AS_OF - WEEK}) AS track_alerts, CASE WHEN count(*) = 0 THEN 0 ELSE round_even(count(category) * 100 / count(*), 0)::BIGINT END AS valid_percent
      FROM items LEFT JOIN assets ON tech_id = id WHERE created_s >= {AS_OF - WEEK}""",
    "source_mix": f"""{VIEWS_SQL}, h AS (SELECT regexp_replace(regexp_replace(lower({NETLOC_SQL}), '^.*@', ''), ':[0-9]*$', '') AS h FROM items WHERE created_s >= {AS_OF - WEEK})
      SELECT CASE WHEN h = 'github.com' OR h LIKE '%.github.com' OR h LIKE '%.githubusercontent.com' THEN 'GitHub' WHEN h IN ('news.ycombinator.com', 'hacker-news.firebaseio.com') THEN 'HN' WHEN h = 'arxiv.org' OR h LIKE '%.arxiv.org' THEN 'arXiv' ELSE 'RSS' END AS label, count(*) AS n FROM h GROUP BY 1""",
    "feed_latest": f"{_SCORED} SELECT {_CARD} FROM scored ORDER BY {_LAT} LIMIT 21",
    "feed_latest_page2": f"{_SCORED} SELECT {_CARD} FROM scored WHERE {_BEHIND} ORDER BY {_LAT} LIMIT 21",
    "feed_latest_alpha": f"{_SCORED} SELECT {_CARD} FROM scored WHERE category = 'Alpha' ORDER BY {_LAT} LIMIT 21",
    "feed_recommended": f"{_SCORED} SELECT {_CARD} FROM scored ORDER BY {_REC} LIMIT 21",
    "feed_recommended_page2": f"{_SCORED} SELECT {_CARD} FROM scored WHERE feed_score IS NULL OR feed_score < 0.3 OR (feed_score = 0.3 AND {_BEHIND}) ORDER BY {_REC} LIMIT 21",
    "feed_recommended_nulltail": f"{_SCORED} SELECT {_CARD} FROM scored WHERE feed_score IS NULL AND {_BEHIND} ORDER BY {_REC} LIMIT 21",
    "feed_hero": f"{_SCORED} SELECT id, title, feed_score, eff_s >= {AS_OF - 48 * 3600} AS fresh FROM scored WHERE feed_score IS NOT NULL ORDER BY fresh DESC, feed_score DESC, id DESC LIMIT 1",
    "feed_diverse_page": f"""{_SCORED.replace("WITH ", "WITH RECURSIVE ", 1)}, {_PAGE}, start AS (SELECT list({{'id': id, 'domain': domain, 'scored': scored, 'place': place, 'seen': seen}}) AS rest, NULL::VARCHAR AS avoid FROM rows20), {_SPREAD}
      SELECT id, domain, scored, place::INTEGER AS place, (step - 1)::INTEGER AS new_place FROM walk JOIN rows20 ON id = pick""",
    "feed_pinned_page": f"""{_SCORED.replace("WITH ", "WITH RECURSIVE ", 1)}, {_PAGE}, chosen AS (SELECT id FROM scored WHERE feed_score IS NOT NULL ORDER BY eff_s >= {AS_OF - 48 * 3600} DESC, feed_score DESC, id DESC LIMIT 1),
      hero AS (SELECT coalesce((SELECT id FROM rows20 WHERE id IN (SELECT id FROM chosen)), (SELECT arg_max(id, (scored, coalesce(feed_score, 0), eff_s, id)) FROM rows20 WHERE eff_s >= {AS_OF - 48 * 3600} AND (SELECT count(*) FROM chosen) > 0)) AS id),
      others AS (SELECT domain, scored, place, id, min(place) OVER (PARTITION BY domain, scored) AS seen FROM front WHERE id IS DISTINCT FROM (SELECT id FROM hero)),
      start AS (SELECT list({{'id': id, 'domain': domain, 'scored': scored, 'place': place, 'seen': seen}}) AS rest, (SELECT domain FROM front WHERE id = (SELECT id FROM hero)) AS avoid FROM others), {_SPREAD},
      shown AS (SELECT step - 1 + CASE WHEN (SELECT id FROM hero) IS NULL THEN 0 ELSE 1 END AS place, pick AS id FROM walk WHERE pick IS NOT NULL UNION ALL SELECT 0, id FROM hero WHERE id IS NOT NULL)
      SELECT place::INTEGER AS place, id, place = 0 AS hero FROM shown""",
    "feed_new_count": f"{VIEWS_SQL} SELECT count(*) AS n FROM items WHERE eff_s > {AS_OF - DAY}",
    "feed_poll_baseline": f"{VIEWS_SQL} SELECT id, eff_s FROM items ORDER BY eff_s DESC, id DESC LIMIT 1",
    "portfolio_recency": f"{_PORT} SELECT * FROM port ORDER BY activity_s DESC, tech_id DESC LIMIT 20",
    "portfolio_trust": f"{_PORT} SELECT * FROM port ORDER BY trust DESC NULLS LAST, activity_s DESC, tech_id DESC LIMIT 20",
    "portfolio_page2": f"{_PORT} SELECT * FROM port WHERE activity_s < {AS_OF - 10 * DAY} OR (activity_s = {AS_OF - 10 * DAY} AND tech_id < 1000000000) ORDER BY activity_s DESC, tech_id DESC LIMIT 20",
    "portfolio_trust_page2": f"{_PORT} SELECT * FROM port WHERE trust IS NULL OR trust < 0.7::DOUBLE OR (trust = 0.7::DOUBLE AND {_TRUST_BEHIND}) ORDER BY trust DESC NULLS LAST, activity_s DESC, tech_id DESC LIMIT 20",
    "portfolio_trust_nulltail": f"{_PORT} SELECT * FROM port WHERE trust IS NULL AND {_TRUST_BEHIND} ORDER BY activity_s DESC, tech_id DESC LIMIT 20",
    "portfolio_groups": f"{VIEWS_SQL} SELECT CASE WHEN i.category IN ('Mainstream', 'Alpha') THEN i.category ELSE 'Mainstream' END AS category, count(*) AS n FROM assets a JOIN items i ON i.id = a.tech_id WHERE a.status = 'Keep' GROUP BY 1",
    "user_portfolio_trust": f"{_SCORED} SELECT id AS tech_id, title, trust, eff_s FROM scored WHERE status = 'Keep' AND category = 'Alpha'",
    "user_portfolio": f"{_SCORED} SELECT id AS tech_id, title, trust, eff_s FROM scored WHERE status = 'Keep'",
    "lineage_counts": f"{VIEWS_SQL} SELECT tech_id, (SELECT count(*) FROM succession WHERE pred = tech_id OR succ = tech_id) AS n_lineage FROM assets WHERE status = 'Keep'",
    "weekly_report": f"""{VIEWS_SQL} SELECT a.tech_id, i.title, (SELECT count(*) FROM history h WHERE h.tech_id = a.tech_id AND changed_s >= {AS_OF - WEEK} AND changed_s < {AS_OF}) AS signals_7d,
      (SELECT count(*) FROM succession x WHERE x.pred = a.tech_id AND edge_s >= {AS_OF - WEEK} AND edge_s < {AS_OF}) AS successions_7d FROM assets a JOIN items i ON i.id = a.tech_id WHERE a.status = 'Keep'""",
    "activity_ticker": f"{VIEWS_SQL} SELECT h.history_id, h.tech_id, h.changed_s, h.changed_from, h.changed_to, m.title AS matched_title FROM history h JOIN assets a USING (asset_id) {_MATCH} WHERE a.status = 'Keep' ORDER BY changed_s DESC, history_id DESC LIMIT 12",
    "timeline_all": f"{_TIMELINE} SELECT * FROM line",
    "timeline_item": f"""{_TIMELINE}, took AS (SELECT x.succ AS tech_id, arg_min(x.pred, (x.edge_s, x.pred)) AS pred, min(x.edge_s) AS edge_s FROM succession x JOIN assets k ON k.tech_id = x.succ AND k.status = 'Keep'
      JOIN assets g ON g.tech_id = x.pred AND g.status = 'Archived' WHERE relation = 'Replace' AND pred <> succ AND x.succ = 20 GROUP BY x.succ),
      every AS (SELECT * FROM line WHERE tech_id = 20 UNION ALL SELECT tech_id, 'handoff', edge_s, pred::VARCHAR, pred FROM took)
      SELECT * FROM every ORDER BY kind = 'handoff' DESC, at_s DESC, CASE kind WHEN 'status' THEN 0 WHEN 'signal' THEN 1 ELSE 2 END, ref DESC, detail LIMIT 12""",
    "inferred_handoff": f"""{VIEWS_SQL} SELECT x.succ AS tech_id, arg_min(x.pred, (x.edge_s, x.pred)) AS pred, min(x.edge_s) AS edge_s FROM succession x JOIN assets k ON k.tech_id = x.succ AND k.status = 'Keep'
      JOIN assets g ON g.tech_id = x.pred AND g.status = 'Archived' WHERE relation = 'Replace' AND pred <> succ GROUP BY x.succ""",
    "replace_successors": f"{VIEWS_SQL} SELECT a.asset_id, x.pred, arg_min(x.succ, (x.edge_s, x.succ)) AS succ FROM succession x JOIN assets a ON a.tech_id = x.pred WHERE relation = 'Replace' AND pred <> succ GROUP BY 1, 2",
    "detail_predecessors": _edges("succ", "pred"),
    "detail_successors": _edges("pred", "succ"),
    "detail_history": f"{VIEWS_SQL} SELECT history_id, tech_id, changed_s, changed_from, changed_to FROM history WHERE changed_to IN ('Keep', 'Tracking', 'Archived') AND tech_id IN {_LOG} ORDER BY (tech_id = 1) DESC, changed_s DESC, history_id DESC LIMIT 10",
    "detail_alerts": f"{VIEWS_SQL} SELECT h.history_id, h.tech_id, h.changed_s, h.changed_from, h.changed_to, m.title AS matched_title FROM history h {_MATCH} WHERE changed_to IN ('succession_alerted', 'signal_matched') AND tech_id IN {_LOG} ORDER BY (tech_id = 1) DESC, changed_s DESC, history_id DESC LIMIT 10",
    "detail_similar": f"{VIEWS_SQL}, {_VEC} SELECT id, round(1 - {_COS.format('vector', '(SELECT vector FROM emb WHERE id = 5)')}, 6) AS distance FROM emb WHERE id <> 5 ORDER BY distance, id LIMIT 5",
    "signals_rolling_7d": f"{VIEWS_SQL} SELECT tech_id, first_day, count(*) AS signals FROM (SELECT tech_id, unnest(range(changed_s // 86400 - 6, changed_s // 86400 + 1)) AS first_day FROM history WHERE changed_to IN ('succession_alerted', 'signal_matched')) GROUP BY 1, 2",
    "vector_search_topk": f"{VIEWS_SQL}, {_VEC} SELECT id, distance, title, category FROM (SELECT id, round(1 - {_COS.format('vector', '(SELECT vector FROM emb WHERE id = 0)')}, 6) AS distance FROM emb ORDER BY distance, id LIMIT 10) JOIN items USING (id)",
    "vector_context_topn": f"{VIEWS_SQL}, {_VEC} SELECT id, distance, left(raw_content, 300) AS context FROM (SELECT id, round(1 - {_COS.format('vector', '(SELECT vector FROM emb WHERE id = 1)')}, 6) AS distance FROM emb WHERE id <> 1 ORDER BY distance, id LIMIT 3) JOIN items USING (id)",
    "similar_pairs": f"{VIEWS_SQL}, {_VEC} SELECT x.id AS a, y.id AS b, round({_COS.format('x.vector', 'y.vector')}, 6) AS cosine FROM emb x JOIN emb y ON x.id < y.id AND {_COS.format('x.vector', 'y.vector')} > {ranking.PAIR}",
    "corroboration_counts": f"{_CORR} SELECT * FROM corr",
    "corroboration_update": f"""{_CORR}, neu AS (SELECT i.* EXCLUDE (corroboration_count), i.corroboration_count AS old_count, c.corroboration AS corroboration_count FROM items i JOIN corr c USING (id))
      SELECT id, old_count, corroboration_count AS new_count, round({TRUST_SQL}, 6) AS new_trust FROM neu WHERE corroboration_count <> coalesce(old_count, 0)""",
    "signal_matches": f"""{VIEWS_SQL}, {_VEC} SELECT a.asset_id, a.tech_id, y.id AS matched_id, round({_COS.format('x.vector', 'y.vector')}, 6) AS cosine FROM assets a JOIN emb x ON x.id = a.tech_id JOIN emb y ON y.id <> x.id AND {_COS.format('x.vector', 'y.vector')} > {ranking.PAIR}
      WHERE a.status = 'Keep' AND NOT EXISTS (SELECT 1 FROM history h WHERE h.asset_id = a.asset_id AND h.changed_to = 'signal_matched' AND h.changed_from = y.id::VARCHAR)""",
    "succession_alerts": f"""{VIEWS_SQL} SELECT a.asset_id, x.succ, arg_min(x.pred, (x.edge_s, x.pred)) AS pred, arg_min(x.relation, (x.edge_s, x.pred)) AS relation, min(x.edge_s) AS edge_s FROM succession x JOIN assets a ON a.tech_id = x.pred
      WHERE a.status = 'Keep' AND pred <> succ AND NOT EXISTS (SELECT 1 FROM history h WHERE h.asset_id = a.asset_id AND h.changed_to = 'succession_alerted' AND h.changed_from = x.succ::VARCHAR) GROUP BY 1, 2""",
    "keep_profile_vector": f"{_KEPT} SELECT dim, round(value, 6) AS value FROM profile",
    "profile_confidence": f"{_KEPT} SELECT round(confidence, 6) AS confidence FROM confidence",
    "kept_at": f"{_KEPT} SELECT * FROM kept",
    "recency_decay": f"{_KEPT} SELECT id, round(weight, 6) AS weight FROM decay",
    "trust_scores": f"{VIEWS_SQL} SELECT id, round({TRUST_SQL}, 6) AS trust FROM items",
    "trending_scores": f"{VIEWS_SQL} SELECT id, round(coalesce(corroboration_count, 0) / (coalesce(corroboration_count, 0) + 1), 6) AS trending FROM items",
    "feed_scores": f"""{_KEPT}, p AS (SELECT list(value ORDER BY dim) AS profile FROM profile)
      SELECT i.id, round(0.35::DOUBLE * CASE WHEN {_AGE} < 0 THEN 0 ELSE pow(0.5::DOUBLE, {_AGE} / 48.0) END
        + 0.35::DOUBLE * CASE WHEN a.status IS NULL AND i.embedding IS NOT NULL THEN {_COS.format('i.embedding::DOUBLE[]', 'p.profile')} * c.confidence ELSE 0 END + 0.15::DOUBLE * coalesce({TRUST_SQL}, 0)
        + 0.15::DOUBLE * (coalesce(corroboration_count, 0) / (coalesce(corroboration_count, 0) + 1)) + CASE WHEN contains(lower(title), 'the') OR contains(lower(title), 'licen') THEN 0.05::DOUBLE ELSE 0 END, 6) AS score
      FROM items i LEFT JOIN assets a ON a.tech_id = i.id, p, confidence c""",
    "briefing_pool": f"{_SCORED}, {_POOL} SELECT id, category, source_url, trust, eff_s, place FROM pool",
    "briefing_selected": f"""{_SCORED}, {_POOL}, {_VEC}, means AS (SELECT category, dim, avg(value) AS v FROM (SELECT i.category, unnest(vector) AS value, generate_subscripts(vector, 1) AS dim FROM emb e JOIN items i ON i.id = e.id WHERE i.category IS NOT NULL AND e.id IN (SELECT tech_id FROM assets WHERE status = 'Keep')) GROUP BY ALL),
      c AS (SELECT category AS centre, list(v ORDER BY dim) AS c FROM means GROUP BY category), topic AS (SELECT vector AS t FROM emb WHERE id = 3),
      near AS (SELECT e.id, max({_COS.format('e.vector', 'c.c')}) AS keep FROM emb e, c GROUP BY e.id),
      s AS (SELECT id, category, CASE WHEN {NETLOC_SQL} = '' THEN 'unknown' ELSE {NETLOC_SQL} END AS source, round(0.4::DOUBLE * coalesce(trust, 0) + 0.35::DOUBLE * CASE WHEN vector IS NULL THEN 0 ELSE {_COS.format('vector', 'topic.t')} END + 0.25::DOUBLE * coalesce(near.keep, 0), 6) AS score
        FROM pool LEFT JOIN emb USING (id) LEFT JOIN near USING (id), topic),
      k AS (SELECT *, row_number() OVER (PARTITION BY category, source ORDER BY score DESC, id DESC) AS k FROM s)
      SELECT id, category, source, score, place FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY score DESC, id DESC) AS place FROM k WHERE k <= 2) WHERE place <= 10""",
    "dedup_urls": f"""{VIEWS_SQL} SELECT * FROM (SELECT 'https://src' || l_partkey % 20 || '.example.com/d/' || l_partkey AS source_url, min(l_orderkey) AS first_order FROM lineitem GROUP BY l_partkey)
      WHERE source_url NOT IN (SELECT source_url FROM items) AND source_url NOT IN (SELECT source_url FROM crawl_queue)""",
    "queue_batch": f"{VIEWS_SQL} SELECT queue_id, source_url, published_s, queued_s FROM crawl_queue ORDER BY published_s DESC NULLS LAST, queued_s, queue_id LIMIT 150",
    "queue_depth": f"{VIEWS_SQL} SELECT count(*) AS n, count(*) FILTER (WHERE published_s IS NULL) AS undated FROM crawl_queue",
    "queue_without_batch": f"{VIEWS_SQL} SELECT queue_id, source_url FROM crawl_queue WHERE source_url NOT IN (SELECT source_url FROM crawl_queue ORDER BY published_s DESC NULLS LAST, queued_s, queue_id LIMIT 150)",
    "asset_toggles": f"""{VIEWS_SQL}, p AS (SELECT doc_id AS tech_id, doc_id % 2 = 0 AS active FROM documents WHERE doc_id % 3 = 0)
      SELECT tech_id, CASE WHEN p.tech_id IS NOT NULL AND NOT active THEN 'Keep' ELSE status END AS status FROM assets a FULL JOIN p USING (tech_id) WHERE NOT coalesce(active AND status = 'Keep', false) AND NOT (status IS NULL AND active)""",
    "briefed_stamp": f"{_SCORED}, {_POOL} SELECT i.id, CASE WHEN i.id IN (SELECT id FROM pool) THEN {AS_OF} WHEN i.id % 7 = 0 THEN {AS_OF - DAY} END AS briefed_s FROM items i",
    "favicon_rows": f"""{VIEWS_SQL}, icon AS (SELECT id, lower(regexp_extract(source_url, '^([A-Za-z]+)://', 1)) || '://' || {NETLOC_SQL} || '/favicon.ico' AS icon FROM items)
      SELECT id, icon || CASE id % 5 WHEN 0 THEN '' WHEN 1 THEN '?v=' || id ELSE '#x' END AS image_url FROM icon WHERE id % 5 < 3""",
    "safe_addresses": f"SELECT page_id, {[ok for _, ok in ingest.ADDRESS_SAMPLES]}[page_id % {len(ingest.ADDRESS_SAMPLES)} + 1] AS safe FROM pages",
    "queue_retained": f"{VIEWS_SQL} SELECT queue_id, queue_id % 3 <> 0 AS valid, queue_id % 2 = 0 AS saved, queue_id % 11 = 0 AS triage_error FROM crawl_queue WHERE (queue_id % 3 <> 0 AND queue_id % 2 <> 0) OR queue_id % 11 = 0",
    "asset_keep_latest": f"{VIEWS_SQL} SELECT asset_id, history_id, changed_to FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY changed_s DESC, history_id DESC) AS n FROM history) WHERE n = 1",
    "asset_requests": f"""{VIEWS_SQL}, r AS (SELECT event_id AS request_id, event_id % 1500 AS tech_id, CASE WHEN event_type IN ('click', 'purchase') THEN 'Keep' ELSE 'Archived' END AS wanted, ts FROM events WHERE event_id % 1500 IN (SELECT doc_id FROM documents)),
      o AS (SELECT r.*, coalesce(lag(wanted) OVER (PARTITION BY r.tech_id ORDER BY date_trunc('second', ts), request_id), status) AS old_status FROM r LEFT JOIN assets a ON a.tech_id = r.tech_id)
      SELECT request_id, tech_id, wanted, old_status, CASE WHEN old_status IS NULL THEN 'CREATED' WHEN old_status = wanted THEN 'NOOP' ELSE 'TRANSITIONED' END AS outcome, old_status IS NOT NULL AND old_status <> wanted AS writes_history FROM o""",
    "asset_transitions": f"""{VIEWS_SQL}, w AS (SELECT doc_id AS tech_id, CASE WHEN doc_id % 3 = 0 THEN 'Keep' ELSE 'Archived' END AS wanted FROM documents)
      SELECT w.tech_id, wanted, status AS old_status, CASE WHEN status IS NULL THEN 'CREATED' WHEN status = wanted THEN 'NOOP' ELSE 'TRANSITIONED' END AS outcome, coalesce(status <> wanted, false) AS writes_history FROM w LEFT JOIN assets USING (tech_id)""",
    "handoff_outcomes": f"""{VIEWS_SQL}, o AS (SELECT pred, succ, CASE WHEN p.status IS NULL THEN 'CREATED' WHEN p.status = 'Archived' THEN 'NOOP' ELSE 'TRANSITIONED' END AS archived,
      CASE WHEN s.status IS NULL THEN 'CREATED' WHEN s.status = 'Keep' THEN 'NOOP' ELSE 'TRANSITIONED' END AS kept FROM succession LEFT JOIN assets p ON p.tech_id = pred LEFT JOIN assets s ON s.tech_id = succ WHERE relation = 'Replace')
      SELECT *, pred <> succ OR (archived = 'NOOP' AND kept = 'NOOP') AS committed FROM o""",
    "event_batch_valid": """SELECT event_id, CASE event_type WHEN 'view' THEN 'impression' WHEN 'click' THEN 'click' ELSE 'dwell' END AS kind, event_id % 1500 AS tech_id, CASE WHEN event_id % 7 <> 0 THEN value END AS value
      FROM events WHERE event_type IN ('view', 'click', 'purchase') AND event_id % 13 <> 0 AND event_id % 1500 IN (SELECT doc_id FROM documents)""",
    "favicon_backfill": f"{VIEWS_SQL} SELECT id, CASE WHEN id % 10 = 0 THEN 'https://img/' || id ELSE lower(regexp_extract(source_url, '^([A-Za-z]+)://', 1)) || '://' || {NETLOC_SQL} || '/favicon.ico' END AS image_url FROM items",
    "run_log": """WITH l AS (SELECT event_id AS line, CASE WHEN event_id % 97 = 0 THEN 'run done' WHEN event_id % 89 = 0 THEN 'Traceback (most recent call last)' WHEN event_id % 10 = 3 THEN 'saved: ' || event_id ELSE 'note' END AS value FROM events),
      m AS (SELECT max(line) FILTER (WHERE value = 'run done') AS ok_line, max(line) FILTER (WHERE value LIKE 'Traceback%') AS failed_line FROM l)
      SELECT ok_line, failed_line, ok_line IS NOT NULL AND coalesce(failed_line, -1) < ok_line AS succeeded,
        CASE WHEN ok_line IS NOT NULL AND coalesce(failed_line, -1) < ok_line THEN (SELECT arg_min(substr(value, 8), line) FROM l WHERE value LIKE 'saved: %' AND line > ok_line) END AS saved FROM m""",
    "pruned_files": "SELECT 'backup-' || lpad(p_partkey::VARCHAR, 7, '0') AS name FROM part ORDER BY name DESC OFFSET 7",
    "digest_candidates": f"{VIEWS_SQL} SELECT id, length(trim(raw_content)) AS n FROM items WHERE length(trim(raw_content)) >= 1000",
    "add_url_status": f"""{VIEWS_SQL}, r AS (SELECT page_id, page_id % 13 AS k, CASE WHEN page_id % 13 = 3 THEN url ELSE url || '#new' END AS url, url AS final_url FROM pages),
      o AS (SELECT page_id, CASE WHEN k = 0 THEN 'rejected:empty' WHEN k = 1 THEN 'rejected:bad_scheme' WHEN k = 2 THEN 'rejected:inner_host' WHEN url IN (SELECT source_url FROM items) THEN 'duplicate:known' WHEN k = 4 THEN 'error:fetch: timeout' WHEN k = 5 THEN 'error:empty'
        WHEN k = 6 AND final_url IN (SELECT source_url FROM items) THEN 'duplicate:known_after_redirect' WHEN k = 7 THEN 'error:triage' WHEN k = 8 THEN 'rejected:unfit' WHEN k = 9 THEN 'error:not_saved' ELSE 'created' END AS o FROM r)
      SELECT page_id, split_part(o, ':', 1) AS outcome, CASE WHEN contains(o, ':') THEN substr(o, strpos(o, ':') + 1) END AS reason FROM o""",
    "title_backfill": f"{VIEWS_SQL} SELECT id, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS new FROM items WHERE id % 4 = 0 OR trim(regexp_replace(title, '\\s+', ' ', 'g')) <> regexp_replace(title, '\\s+', ' ', 'g')",
    "digest_backfill": f"""{VIEWS_SQL} SELECT id, (5 * (id % 60) - 1)::INTEGER AS n FROM items WHERE id % 10 <> 0 AND length(regexp_replace(raw_content, '^\\s+|\\s+$', '', 'g')) >= 1000 AND 5 * (id % 60) - 1 >= 150 AND id % 7 <> 0""",
    "trust_backfill": f"""{VIEWS_SQL} SELECT id, round(least(1.0, 0.6::DOUBLE * (CASE WHEN id % 2 = 0 THEN 0.25::DOUBLE ELSE 0 END + 0.2::DOUBLE + 0.07::DOUBLE) + 0.2::DOUBLE * ({PRIOR_SQL}) + 0.2::DOUBLE * least(coalesce(corroboration_count, 0), 3) / 3), 6) AS trust
      FROM items WHERE NOT has_rubric AND id % 5 <> 0""",
    "resolve_events": VIEWS_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + """, walk AS (SELECT event_id, event_id AS pos, [event_id] AS seen, 0 AS hop FROM tech_events
      UNION ALL SELECT w.event_id, t.merged_into, list_append(w.seen, t.merged_into), hop + 1 FROM walk w JOIN tech_events t ON t.event_id = w.pos WHERE t.merged_into IS NOT NULL AND NOT list_contains(w.seen, t.merged_into) AND hop < 8)
      SELECT event_id, arg_max(pos, hop) AS resolved_id FROM walk GROUP BY event_id""",
    "event_documents": f"{VIEWS_SQL} SELECT event_id, tech_id, title, published_s FROM event_documents JOIN items ON id = tech_id",
    "event_entities": f"{VIEWS_SQL} SELECT event_id, entity FROM event_entities",
    "events_for_entity": f"{VIEWS_SQL} SELECT entity, event_id, occurred_s FROM event_entities JOIN tech_events USING (event_id)",
    "feed_event_counts": f"{VIEWS_SQL} SELECT kind, count(*) AS n, count(*) FILTER (WHERE tech_id NOT IN (SELECT doc_id FROM documents)) AS dangling, round(avg(value), 4) AS mean_value FROM feed_events GROUP BY kind",
    "preflight_reject": "SELECT doc_id AS id FROM documents WHERE regexp_matches(left(text, 2000), '\\b(?:" + "|".join([*REJECTED, *texts.SAMPLE_PHRASES]).replace("'", "''") + ")\\b', 'i')",
    "exclusion_hits": "SELECT * FROM (SELECT doc_id AS id, array_to_string(list_filter(['license', 'stupid', 'password'], lambda t: contains(lower(text), t)), ',') AS hits FROM documents) WHERE hits <> ''",
    "interest_hits": f"{VIEWS_SQL} SELECT id FROM items WHERE contains(lower(title), 'the') OR contains(lower(title), 'licen')",
    "title_from_content": f"{VIEWS_SQL} SELECT id, title FROM items",
    "clean_titles": f"{VIEWS_SQL} SELECT id, trim(regexp_replace(title, '\\s+', ' ', 'g')) || CASE WHEN id % 3 = 0 THEN ' & Vec<T>' ELSE '' END AS title FROM items",
    "page_text": f"""WITH parts AS (SELECT page_id, url AS source_url, regexp_extract(html, '<title>(.*?)</title>', 1, 's') AS title, regexp_replace(regexp_replace(regexp_extract(html, '<article>(.*?)(?:</article>|$)', 1, 's'), '</?(?:h1|p|br)[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g') AS body FROM pages),
      plain AS (SELECT page_id, source_url, replace(replace(title, '&quot;', '"'), '&amp;', '&') AS title, replace(replace(body, '&quot;', '"'), '&amp;', '&') AS body FROM parts)
      SELECT page_id, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS title, array_to_string(list_filter(list_transform(string_split(body, chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS content,
        NULL::BIGINT AS published_s, regexp_extract(source_url, '^([a-z]+)://', 1) || '://' || {NETLOC_SQL} || '/favicon.ico' AS image FROM plain""",
    "canonical_names": "SELECT trim(regexp_replace(regexp_replace(lower(p_name), '[-_/&,]+', ' ', 'g'), '\\s+', ' ', 'g')) AS name, count(DISTINCT p_name) AS spellings FROM part GROUP BY 1",
    "simhash_docs_md5": f"WITH {_FOLDED} SELECT * FROM hashes",
    "near_dup_pairs_md5": f"""WITH {_FOLDED}, g AS (SELECT simhash, min(doc_id) AS id, count(*) AS n FROM hashes GROUP BY simhash)
      SELECT x.id AS a, y.id AS b, bit_count(xor(x.simhash, y.simhash))::INTEGER AS distance, x.n AS copies_a, y.n AS copies_b FROM g x JOIN g y ON x.id < y.id AND bit_count(xor(x.simhash, y.simhash)) <= 3""",
    "item_by_id": f"{VIEWS_SQL} SELECT id, title, source_url, category, created_s FROM items WHERE id = 7",
    "item_by_url": f"{VIEWS_SQL} SELECT id FROM items WHERE source_url = 'https://github.com/own23/repo23'",
    "vector_search_keep": f"""{VIEWS_SQL}, {_VEC} SELECT id, round(1 - {_COS.format('vector', '(SELECT vector FROM emb WHERE id = 0)')}, 6) AS distance, title, category FROM emb JOIN items USING (id) JOIN assets ON tech_id = id
      WHERE category = 'Alpha' AND status = 'Keep' ORDER BY distance, id LIMIT 10""",
    "domains_all": f"""SELECT page_id, {NETLOC_SQL} AS netloc, {DOMAIN_SQL} AS domain, regexp_replace(regexp_replace(lower({NETLOC_SQL}), '^.*@', ''), ':[0-9]*$', '') AS host, {NETLOC_SQL} AS briefing, 'RSS' AS label,
      regexp_extract(source_url, '^([a-z]+)://', 1) || '://' || {NETLOC_SQL} || '/favicon.ico' AS favicon,
      CASE WHEN len(parts) >= 2 THEN parts[1] || '/' || parts[2] END AS slug FROM (SELECT page_id, url AS source_url, list_filter(string_split(regexp_replace(regexp_replace(url, '^[a-z]+://[^/?#]*', ''), '[?#].*$', ''), '/'), lambda p: p <> '') AS parts FROM pages)""",
    "arxiv_canonical": "SELECT 'https://arxiv.org/abs/2401.' || lpad((p_partkey % 500)::VARCHAR, 5, '0') AS url, count(*) AS n FROM part GROUP BY 1",
    "entity_key": "SELECT lower(trim(regexp_replace(p_name, '\\s+', ' ', 'g'))) AS entity, count(*) AS n FROM part GROUP BY 1",
    "exact_dup_groups": "SELECT md5(text) AS digest, min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1",
    "entity_doc_freq": """SELECT word, count(*) AS docs FROM (SELECT DISTINCT doc_id, regexp_replace(unnest(regexp_split_to_array(text, '[ \\n]')), '[.,!;:]+$', '') AS word FROM documents)
      WHERE regexp_full_match(word, '[A-Z][a-z]+') GROUP BY word HAVING count(*) <= (SELECT count(*) FROM documents) * 0.5""",
    **batch.ORACLE_SQL,
    **collect.ORACLE_SQL,
    **scale.ORACLE_SQL,
}
