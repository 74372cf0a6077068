"""What is done to one page on the driver (a page has a limit, so its rows are bounded): cursors, diversity, hero."""

from __future__ import annotations

import base64
import json
from collections import defaultdict, deque

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import urls
from lodestar.operators import reads


def encode_cursor(sort: str, *key) -> str:
    """A page's last row as text: base64url of compact JSON, tagged with the order."""
    raw = json.dumps({"s": {"latest": "lat", "recommended": "rec"}[sort], "k": list(key)}, separators=(",", ":"))
    return base64.urlsafe_b64encode(raw.encode()).decode().rstrip("=")


def decode_cursor(text: str, sort: str) -> tuple:
    """(sort, *key); ValueError for what isn't a cursor of this order."""
    try:
        found = json.loads(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)))
        tag, key = found["s"], found["k"]
    except Exception as e:
        raise ValueError("not a cursor") from e
    if tag != {"latest": "lat", "recommended": "rec"}[sort] or len(key) != (2 if sort == "latest" else 3):
        raise ValueError("this cursor belongs to another order")
    return (sort, *key)


def spread(domains: list[str], avoid: str | None = None) -> list[int]:
    """An order of the places of domains in which no two neighbours are equal where that can be had: always the domain with most
    left that isn't the last one taken, the first seen of equals; within a domain the order stays."""
    waiting: dict[str, deque] = defaultdict(deque)
    for place, domain in enumerate(domains):
        waiting[domain].append(place)
    out: list[int] = []
    last = avoid
    while len(out) < len(domains):
        left = [d for d in waiting if waiting[d]]
        choice = max([d for d in left if d != last] or left, key=lambda d: len(waiting[d]))
        out.append(waiting[choice].popleft())
        last = choice
    return out


def spread_bands(domains: list[str], scored: list[bool], avoid: str | None = None) -> list[int]:
    """spread, for the scored rows and then for the others, which never move up between scored ones."""
    first, rest = [i for i, s in enumerate(scored) if s], [i for i, s in enumerate(scored) if not s]
    out = [first[i] for i in spread([domains[i] for i in first], avoid)]
    return out + [rest[i] for i in spread([domains[i] for i in rest], domains[out[-1]] if out else avoid)]


def diverse_pages(df: DataFrame, page: str) -> DataFrame:
    """df (page column, place, domain, scored) with the place after spread_bands, page by page; pages are bounded groups."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", new_place int"

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place").reset_index(drop=True)
        order = spread_bands(pdf["domain"].tolist(), pdf["scored"].tolist())
        return pdf.iloc[order].assign(new_place=range(len(order)))

    return df.groupBy(page).applyInPandas(one, schema)


def _first_page(spark: SparkSession, sf_dir: str, limit: int) -> list:
    """The rows of the first recommended page. The page has a limit, so what is done to it isn't done to all rows."""
    df = reads.scored_items(spark, sf_dir).select("id", "feed_score", "eff_s", urls.domain(F.col("source_url")).alias("domain"))
    return reads.page(df, F.col("feed_score").desc_nulls_last(), F.desc("eff_s"), F.desc("id"), limit=limit).collect()


def feed_diverse_page(spark: SparkSession, sf_dir: str, limit: int = 20) -> DataFrame:
    """The first recommended page, reordered."""
    placed = [(r.id, r.place, r.domain, r.feed_score is not None, 0) for r in _first_page(spark, sf_dir, limit)]
    df = spark.createDataFrame(placed, "id long, place int, domain string, scored boolean, page int")
    return diverse_pages(df, "page").select("id", "domain", "scored", "place", "new_place")


def pin_hero(ids: list[int], domains: list[str], scored: list[bool], hero: int | None) -> list[int]:
    """Ids with the hero first, and the rest spread so that the next differs from the hero's domain."""
    if hero is None or hero not in ids:
        return [ids[i] for i in spread_bands(domains, scored)]
    at = ids.index(hero)
    rest = [i for i in range(len(ids)) if i != at]
    return [hero] + [ids[rest[k]] for k in spread_bands([domains[i] for i in rest], [scored[i] for i in rest], domains[at])]


def recovered_hero(ids: list[int], scores: list[float | None], times: list[int], since: int) -> int | None:
    """The page's best row of the window: a score before none, then the higher score, time and id; None if no row is recent enough."""
    best = [(s is not None, s or 0.0, t, i) for i, s, t in zip(ids, scores, times) if t >= since]
    return max(best)[3] if best else None


def lead(rows: list, sort: str, selected: int | None, since: int) -> tuple[list[int], int | None]:
    """The first page's ids as shown, and the one shown large. By time nothing moves and the newest leads. Else the selected item leads if it is on the page, or
    the best recent one of the page; if there is none either, or nothing has a score (selected is None), the first of the page as it is spread."""
    ids, domains, scored = [r.id for r in rows], [r.domain for r in rows], [r.feed_score is not None for r in rows]
    if sort == "latest":
        return ids, ids[0] if ids else None
    hero = selected if selected in ids else recovered_hero(ids, [r.feed_score for r in rows], [r.eff_s for r in rows], since) if selected is not None else None
    shown = pin_hero(ids, domains, scored, hero)
    return shown, shown[0] if shown else None


def feed_pinned_page(spark: SparkSession, sf_dir: str, limit: int = 20) -> DataFrame:
    """The first recommended page as shown: its hero on top."""
    selected = reads.feed_hero(spark, sf_dir).first()
    shown, hero = lead(_first_page(spark, sf_dir, limit), "recommended", selected and selected.id, reads.AS_OF - reads.HERO_S)
    return spark.createDataFrame([(k, i, i == hero) for k, i in enumerate(shown)], "place int, id long, hero boolean")


def encode_portfolio_cursor(activity_s: int, item: int, trust: float | None) -> str:
    """A portfolio page's last row as text; it serves both orders."""
    raw = json.dumps({"k": activity_s, "u": item, "t": trust}, separators=(",", ":"))
    return base64.urlsafe_b64encode(raw.encode()).decode().rstrip("=")


def decode_portfolio_cursor(text: str) -> tuple:
    """(trust, activity_s, item), as reads.portfolio takes it; ValueError for what isn't such a cursor."""
    try:
        found = json.loads(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)))
        trust = found["t"]
        return None if trust is None else float(trust), int(found["k"]), int(found["u"])
    except Exception as e:
        raise ValueError("not a portfolio cursor") from e
