"""What is crawled: raw answers of sources as items, their union, and what of it is new."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions import text as X
from lodestar.functions import urls
from lodestar.sources import tables as T
from lodestar.sources.tables import AS_OF

log = logging.getLogger(__name__)

#: Bytes of a text that are kept.
RAW_BYTES = 8192
COLUMNS = ["title", "source_url", "raw_content", "image_url", "published_s", "source_category"]


def _typed(value: Column, name: str, kind: str, *schemas: str) -> Column:
    """A field of a parsed JSON value, null if it isn't there in one of the schemas."""
    found = F.schema_of_variant(F.try_variant_get(value, f"$.{name}", "variant"))
    return F.when(found.rlike("^(?:" + "|".join(schemas) + ")"), F.try_variant_get(value, f"$.{name}", kind))


def hackernews_items(raw: DataFrame, bodies: DataFrame | None = None) -> DataFrame:
    """Items of (item_id, payload). What isn't an object is left out; the discussion stands for an address that isn't http(s). The content is the title
    with the post's text, else with the article's body (bodies: url, body, image_url), else alone."""
    v = F.try_parse_json("payload")
    df = raw.select("item_id", v.alias("v")).where(F.schema_of_variant("v").startswith("OBJECT"))
    df = df.select(
        "item_id",
        _typed(F.col("v"), "url", "string", "STRING").alias("url"),
        X.clean_title(F.coalesce(_typed(F.col("v"), "title", "string", "STRING"), F.lit(""))).alias("title"),
        X.clean_title(F.coalesce(_typed(F.col("v"), "text", "string", "STRING"), F.lit(""))).alias("text"),
        F.floor(_typed(F.col("v"), "time", "double", "BIGINT", "DOUBLE", "FLOAT", "DECIMAL")).cast("long").alias("published_s"),
    )
    outside = F.coalesce(F.lower("url").rlike("^https?://"), F.lit(False))
    df = df.withColumn("outside", outside).withColumn("source_url", F.when(outside, F.col("url")).otherwise(F.concat(F.lit("https://news.ycombinator.com/item?id="), F.col("item_id").cast("string"))))
    if bodies is not None:
        df = df.join(bodies.select(F.col("url").alias("source_url"), "body", "image_url"), "source_url", "left")
    else:
        df = df.withColumns({"body": F.lit(None).cast("string"), "image_url": F.lit(None).cast("string")})
    below = F.when(F.col("text") != "", F.col("text")).when(F.col("outside") & (F.col("body") != ""), F.col("body"))
    content = F.when(below.isNull(), F.col("title")).otherwise(X.stripped(F.concat("title", F.lit("\n\n"), below)))
    image = F.when(F.col("outside") & (F.col("text") == ""), F.col("image_url"))
    return df.select("title", "source_url", X.truncate_utf8(content, F.lit(RAW_BYTES)).alias("raw_content"), image.alias("image_url"), "published_s", F.lit(None).cast("string").alias("source_category"))


_ENTRY = "title string, link struct<_VALUE string, _href string>, description string, summary string, content string, encoded string, pubDate string, published string, updated string"


def feed_items(entries: DataFrame) -> DataFrame:
    """Items of (entry, category): RSS items and Atom entries as XML. One without title or link is left out; the full content goes before the
    summary, and that before the description."""
    x = entries.select(F.from_xml("entry", _ENTRY, {"ignoreNamespace": "true"}).alias("x"), "category").select("x.*", "category")
    link = F.coalesce("link._VALUE", "link._href")
    zone = F.regexp_replace(F.regexp_replace("pubDate", r"^\s*[A-Za-z]{3},\s*", ""), r"\s(?:GMT|UTC|UT|Z)$", " +0000")
    at = F.coalesce(F.try_to_timestamp(zone, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp("published"), F.try_to_timestamp("updated"))
    body = F.coalesce("encoded", "content", F.nullif("summary", F.lit("")), "description", F.lit(""))
    df = x.select(X.clean_title("title").alias("title"), F.trim(link).alias("source_url"), body.alias("body"), F.unix_seconds(at).alias("published_s"), F.col("category").alias("source_category"))
    df = df.where((F.col("title") != "") & (F.col("source_url") != ""))
    content = X.truncate_utf8(F.concat("title", F.lit("\n\n"), "body"), F.lit(RAW_BYTES))
    return df.select("title", "source_url", content.alias("raw_content"), F.lit(None).cast("string").alias("image_url"), "published_s", "source_category")


def trending_items(pages: DataFrame, readmes: DataFrame | None = None) -> DataFrame:
    """Items of (html): the entries of listings of repositories, their description with the readme (readmes: slug, readme) below."""
    df = pages.select(F.explode(X.read_trending("html")).alias("e")).select("e.*").withColumn("source_url", F.concat(F.lit("https://github.com"), "href"))
    content = F.col("description")
    if readmes is not None:
        df = df.withColumn("slug", urls.github_slug(F.col("source_url"))).join(readmes, "slug", "left")
        content = F.when(F.col("readme") != "", F.concat_ws("\n\n", F.nullif("description", F.lit("")), "readme")).otherwise(F.col("description"))
    return df.select("title", "source_url", X.truncate_utf8(content, F.lit(RAW_BYTES)).alias("raw_content"), urls.favicon(F.col("source_url")).alias("image_url"), F.lit(None).cast("long").alias("published_s"), F.lit(None).cast("string").alias("source_category"))


def listing_links(pages: DataFrame, pattern: str, most: int) -> DataFrame:
    """(page_id, url, place) of (page_id, url, html): the first most different links of each page that fit the pattern and stay on its host, without fragments."""
    hrefs = F.regexp_extract_all("html", F.lit("href=[\"']([^\"']+)[\"']"), 1)
    df = pages.select("page_id", F.col("url").alias("base"), F.posexplode(hrefs).alias("at", "href")).where(F.col("href").rlike(pattern))
    base = F.col("base")
    root = F.concat(F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://)", 1), urls.netloc(base))
    folder = F.when(F.regexp_replace(base, r"[?#].*$", "") == root, F.concat(root, F.lit("/"))).otherwise(F.regexp_extract(F.regexp_replace(base, r"[?#].*$", ""), r"^(.*/)", 1))
    whole = (
        F.when(F.col("href").startswith("http"), F.col("href"))
        .when(F.col("href").startswith("//"), F.concat(F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1), "href"))
        .when(F.col("href").startswith("/"), F.concat(root, "href"))
        .when(F.col("href").startswith("?"), F.concat(F.regexp_replace(base, r"[?#].*$", ""), "href"))
        .when(F.col("href").startswith("#"), base)
        .otherwise(F.concat(folder, "href"))
    )
    df = df.withColumn("url", F.substring_index(whole, "#", 1)).where((urls.netloc(F.col("url")) != "") & (urls.netloc(F.col("url")) == urls.netloc(base)))
    first = df.groupBy("page_id", "url").agg(F.min("at").alias("at"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("page_id").orderBy("at"))).where(F.col("place") <= most).select("page_id", "url", "place")


def arxiv_recent(entries: DataFrame, as_of: int = AS_OF, hours: int = 24, most: int = 100) -> DataFrame:
    """The newest entries (title, url, summary, published_s) of the last hours as items, with one address for all versions."""
    df = entries.where(F.col("published_s") >= as_of - hours * 3600).orderBy(F.desc("published_s"), "url").limit(most)
    return df.select("title", urls.arxiv_canonical(F.col("url")).alias("source_url"), F.concat("title", F.lit("\n\n"), "summary").alias("raw_content"), F.lit(None).cast("string").alias("image_url"), "published_s", F.lit(None).cast("string").alias("source_category"))


def crawl(sources: dict[str, Callable[[], DataFrame]]) -> DataFrame:
    """The items of all sources, each tagged with its source's name; one that can't be read is left out."""
    found = None
    for name, build in sources.items():
        try:
            items = build().select(*COLUMNS).withColumn("source", F.lit(name))
        except Exception as e:  # a source may fail in any way
            log.warning("source %s is left out: %s", name, e)
            continue
        found = items if found is None else found.unionByName(items, allowMissingColumns=True)
    if found is None:
        raise ValueError("no source could be read")
    return found


def new_items(crawled: DataFrame, known: DataFrame) -> DataFrame:
    """Of each address the item that comes first by source and title, if known (source_url) doesn't have it."""
    place = F.row_number().over(Window.partitionBy("source_url").orderBy("source", "title"))
    return crawled.where(F.trim("source_url") != "").withColumn("_n", place).where("_n = 1").drop("_n").join(known.select("source_url"), "source_url", "left_anti")


def tallies(crawled: DataFrame) -> DataFrame:
    """Items by source."""
    return crawled.groupBy(F.coalesce("source", F.lit("unknown")).alias("source")).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- over the driver's tables


def raw_hackernews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A payload for each document: with a link, with a text, with fields of other types, and no object."""
    i = F.col("doc_id")
    n = i.cast("string")
    title = F.concat(F.lit("Show <b>"), n, F.lit("</b> &amp; co"))
    payload = (
        F.when(i % 4 == 0, F.to_json(F.struct(title.alias("title"), F.concat(F.lit("https://ex.org/"), n).alias("url"), (i * 60).alias("time"))))
        .when(i % 4 == 1, F.to_json(F.struct(title.alias("title"), F.concat(F.lit("<p>hello &lt;"), n, F.lit("</p>")).alias("text"), (i + 0.5).alias("time"))))
        .when(i % 4 == 2, F.to_json(F.struct(i.alias("title"), F.concat(F.lit("ftp://ex.org/"), n).alias("url"), n.alias("time"))))
        .otherwise(F.concat(F.lit("["), n, F.lit("]")))
    )
    return T.read(spark, sf_dir, "documents").select(i.alias("item_id"), payload.alias("payload"))


def hackernews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of raw_hackernews; every eighth link has a body."""
    i = F.col("doc_id")
    bodies = T.read(spark, sf_dir, "documents").where(i % 8 == 0).select(F.concat(F.lit("https://ex.org/"), i.cast("string")).alias("url"), F.left("text", F.lit(100)).alias("body"), F.concat(F.lit("https://img/"), i.cast("string")).alias("image_url"))
    return hackernews_items(raw_hackernews(spark, sf_dir), bodies)


def feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of entries made from the parts: RSS and Atom in turn, some without link."""
    k = F.col("p_partkey")
    n = k.cast("string")
    at = F.timestamp_seconds(F.lit(AS_OF) - k * 613 % 43200 * 60)
    rss = F.concat(F.lit("<item><title>New &amp; "), n, F.lit("</title>"), F.when(k % 6 == 2, "").otherwise(F.concat(F.lit("<link>https://feed.example.com/"), n, F.lit("</link>"))), F.lit("<description>About "), "p_name", F.lit("</description><pubDate>"), F.date_format(at, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT</pubDate></item>"))
    atom = F.concat(F.lit('<entry xmlns="http://www.w3.org/2005/Atom"><title>Atom '), n, F.lit('</title><link href="https://atom.example.com/'), n, F.lit('"/><summary>s</summary><content>full '), "p_name", F.lit("</content><published>"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("</published></entry>"))
    entries = T.read(spark, sf_dir, "part").select(F.when(k % 2 == 0, rss).otherwise(atom).alias("entry"), F.when(k % 2 == 0, "Mainstream").otherwise("Alpha").alias("category"))
    return feed_items(entries)


def trending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of one listing a supplier, of two entries and one that leads elsewhere."""
    k = F.col("s_suppkey")
    n = k.cast("string")
    entry = lambda href, name, text: F.concat(F.lit('<article class="Box-row x"><h2 class="h3 lh-condensed"><a href="'), href, F.lit('"> '), name, F.lit(" </a></h2>"), text, F.lit("</article>"))
    html = F.concat(
        entry(F.concat(F.lit("/own"), n, F.lit("/one")), F.concat(F.lit("own"), n, F.lit(" / one")), F.lit('<p class="col-9 color-fg-muted my-1">A &amp; B</p>')),
        entry(F.concat(F.lit("/own"), n, F.lit("/two")), F.lit("two &lt;T&gt;"), F.lit("")),
        entry(F.lit("https://ads.example.com/"), F.lit("ad"), F.lit("<p>buy</p>")),
    )
    readmes = T.read(spark, sf_dir, "supplier").where(k % 2 == 0).select(F.concat(F.lit("own"), n, F.lit("/one")).alias("slug"), F.concat(F.lit("# Read "), n).alias("readme"))
    return trending_items(T.read(spark, sf_dir, "supplier").select(html.alias("html")), readmes)


def links(spark: SparkSession, sf_dir: str, most: int = 3) -> DataFrame:
    """The first links to capitalised names of every page."""
    return listing_links(T.read(spark, sf_dir, "pages").select("page_id", "url", "html"), "^/[A-Z]", most)


def arxiv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of the last two days of entries made from the parts."""
    k = F.col("p_partkey")
    entries = T.read(spark, sf_dir, "part").select(F.col("p_name").alias("title"), F.concat(F.lit("http://arxiv.org/abs/2402."), F.lpad(k.cast("string"), 5, "0"), F.lit("v2")).alias("url"), F.lit("abstract").alias("summary"), (F.lit(AS_OF) - k * 613 % 43200 * 60).alias("published_s"))
    return arxiv_recent(entries, hours=48)


def crawled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of the above, and a source that fails."""
    page_links = lambda: links(spark, sf_dir).select(*[F.lit(None).cast("long" if c == "published_s" else "string").alias(c) if c != "source_url" else F.col("url").alias(c) for c in COLUMNS])
    return crawl({
        "hackernews": lambda: hackernews(spark, sf_dir), "github_trending": lambda: trending(spark, sf_dir), "rss": lambda: feeds(spark, sf_dir),
        "arxiv": lambda: arxiv(spark, sf_dir), "spa": page_links, "broken": lambda: T.read(spark, sf_dir, "no_such_table"),
    })


def crawl_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items found and items new, by source."""
    known = T.items(spark, sf_dir, "source_url").union(T.crawl_queue(spark, sf_dir).select("source_url"))
    found = crawled(spark, sf_dir).select("title", "source_url", "source")
    return tallies(found).join(tallies(new_items(found, known)).withColumnRenamed("n", "new"), "source", "left").select("source", "n", F.coalesce("new", F.lit(0)).alias("new"))


VIEWS_SQL = f"""{T.VIEWS_SQL},
hn AS (SELECT CASE doc_id % 4 WHEN 2 THEN '' ELSE 'Show ' || doc_id || ' & co' END AS title, CASE doc_id % 4 WHEN 0 THEN 'https://ex.org/' || doc_id ELSE 'https://news.ycombinator.com/item?id=' || doc_id END AS source_url,
  CASE WHEN doc_id % 4 = 2 THEN '' WHEN doc_id % 4 = 1 THEN 'Show ' || doc_id || ' & co' || chr(10) || chr(10) || 'hello <' || doc_id
    WHEN doc_id % 8 = 0 AND text <> '' THEN regexp_replace('Show ' || doc_id || ' & co' || chr(10) || chr(10) || left(text, 100), '\\s+$', '') ELSE 'Show ' || doc_id || ' & co' END AS raw_content,
  CASE WHEN doc_id % 8 = 0 THEN 'https://img/' || doc_id END AS image_url, CASE doc_id % 4 WHEN 0 THEN doc_id * 60 WHEN 1 THEN doc_id END AS published_s, NULL::VARCHAR AS source_category FROM documents WHERE doc_id % 4 <> 3),
feed AS (SELECT CASE p_partkey % 2 WHEN 0 THEN 'New & ' || p_partkey ELSE 'Atom ' || p_partkey END AS title, CASE p_partkey % 2 WHEN 0 THEN 'https://feed.example.com/' ELSE 'https://atom.example.com/' END || p_partkey AS source_url,
  CASE p_partkey % 2 WHEN 0 THEN 'New & ' || p_partkey || chr(10) || chr(10) || 'About ' || p_name ELSE 'Atom ' || p_partkey || chr(10) || chr(10) || 'full ' || p_name END AS raw_content, NULL::VARCHAR AS image_url,
  {AS_OF} - p_partkey * 613 % 43200 * 60 AS published_s, CASE p_partkey % 2 WHEN 0 THEN 'Mainstream' ELSE 'Alpha' END AS source_category FROM part WHERE p_partkey % 6 <> 2),
trend AS (SELECT CASE k WHEN 1 THEN 'own' || s_suppkey || ' / one' ELSE 'two <T>' END AS title, 'https://github.com/own' || s_suppkey || CASE k WHEN 1 THEN '/one' ELSE '/two' END AS source_url,
  CASE WHEN k = 1 AND s_suppkey % 2 = 0 THEN 'A & B' || chr(10) || chr(10) || '# Read ' || s_suppkey WHEN k = 1 THEN 'A & B' ELSE 'two <T>' END AS raw_content, 'https://github.com/favicon.ico' AS image_url, NULL::BIGINT AS published_s, NULL::VARCHAR AS source_category
  FROM supplier, (VALUES (1), (2)) v(k)),
hrefs AS (SELECT page_id, url, unnest(regexp_extract_all(html, 'href=["'']([^"'']+)["'']', 1)) AS href, generate_subscripts(regexp_extract_all(html, 'href=["'']([^"'']+)["'']', 1), 1) AS spot FROM pages),
links AS (SELECT page_id, url, row_number() OVER (PARTITION BY page_id ORDER BY spot) AS place FROM (
  SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*') || split_part(href, '#', 1) AS url, min(spot) AS spot FROM hrefs WHERE regexp_matches(href, '^/[A-Z]') GROUP BY 1, 2) QUALIFY place <= 3),
arx AS (SELECT p_name AS title, 'https://arxiv.org/abs/2402.' || lpad(p_partkey::VARCHAR, 5, '0') AS source_url, p_name || chr(10) || chr(10) || 'abstract' AS raw_content, NULL::VARCHAR AS image_url, {AS_OF} - p_partkey * 613 % 43200 * 60 AS published_s, NULL::VARCHAR AS source_category
  FROM part WHERE p_partkey * 613 % 43200 * 60 <= 48 * 3600 ORDER BY published_s DESC, 'http://arxiv.org/abs/2402.' || lpad(p_partkey::VARCHAR, 5, '0') LIMIT 100),
crawled AS (SELECT title, source_url, 'hackernews' AS source FROM hn UNION ALL SELECT title, source_url, 'rss' FROM feed UNION ALL SELECT title, source_url, 'github_trending' FROM trend
  UNION ALL SELECT title, source_url, 'arxiv' FROM arx UNION ALL SELECT NULL, url, 'spa' FROM links),
fresh AS (SELECT source, count(*) AS n FROM (SELECT source, source_url, row_number() OVER (PARTITION BY source_url ORDER BY source, title NULLS FIRST) AS k FROM crawled) WHERE k = 1
  AND source_url NOT IN (SELECT source_url FROM items) AND source_url NOT IN (SELECT source_url FROM crawl_queue) GROUP BY source)
"""
QUERIES = {"source_hackernews": hackernews, "source_feeds": feeds, "source_trending": trending, "source_links": links, "source_arxiv": arxiv, "crawl_tallies": crawl_tallies}
ORACLE_SQL = {
    "source_hackernews": f"{VIEWS_SQL} SELECT * FROM hn",
    "source_feeds": f"{VIEWS_SQL} SELECT * FROM feed",
    "source_trending": f"{VIEWS_SQL} SELECT * FROM trend",
    "source_links": f"{VIEWS_SQL} SELECT page_id, url, place::INTEGER AS place FROM links",
    "source_arxiv": f"{VIEWS_SQL} SELECT * FROM arx",
    "crawl_tallies": f"{VIEWS_SQL} SELECT c.source, count(*) AS n, coalesce(any_value(f.n), 0) AS new FROM crawled c LEFT JOIN fresh f USING (source) GROUP BY c.source",
}
