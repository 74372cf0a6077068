"""Scoring formulas as Column expressions, with the same as SQL text where a query needs it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Settings:
    """Weights and thresholds; the defaults are the fixed values of the system this engine stands in for."""

    weight_recency: float = 0.35
    weight_profile: float = 0.35
    weight_trust: float = 0.15
    weight_trending: float = 0.15
    interest_bonus: float = 0.05
    half_life_hours: float = 48.0
    pass_weight: float = 0.3
    trust_rubric: float = 0.6
    trust_prior: float = 0.2
    trust_corroboration: float = 0.2
    similarity: float = 0.85
    lookback_days: int = 7
    source_tiers: dict = field(default_factory=lambda: dict.fromkeys(
        ["arxiv.org", "github.com", "openai.com", "anthropic.com", "ai.googleblog.com", "huggingface.co", "blog.google", "ai.meta.com", "mistral.ai"], "high"))


SETTINGS = Settings()
#: Prior of a source by its tier.
TIER_PRIOR = {"high": 1.0, "normal": 0.5, "low": 0.2}


def recency_decay(age_hours: Column, half_life: float = SETTINGS.half_life_hours) -> Column:
    """Halves every half_life hours; 0 for the future; a half-life of 0 or less leaves age 0 alone."""
    if half_life <= 0:
        return F.when(age_hours == 0, 1.0).otherwise(0.0)
    return F.when(age_hours < 0, 0.0).otherwise(F.pow(F.lit(0.5), age_hours / half_life))


def trending_score(count: Column) -> Column:
    c = F.greatest(F.coalesce(count, F.lit(0)), F.lit(0))
    return c / (c + 1)


def corroboration_score(count: Column) -> Column:
    return F.least(F.greatest(F.coalesce(count, F.lit(0)), F.lit(0)), F.lit(3)) / 3


def score_rubric(primary: Column, links: Column, numbers: Column, balance: Column, marketing: Column) -> Column:
    """Points for each of five answers; unknown words give none; between 0 and 1."""
    points = (
        F.when(primary, 0.25).otherwise(0.0) + F.when(links, 0.20).otherwise(0.0) + F.when(numbers, 0.20).otherwise(0.0)
        + F.when(balance == "balanced", 0.20).when(balance == "mixed", 0.10).otherwise(0.0)
        + F.when(marketing == "low", 0.15).when(marketing == "medium", 0.07).otherwise(0.0)
    )
    return F.least(F.greatest(points, F.lit(0.0)), F.lit(1.0))


def source_prior(domain: Column, tiers: dict | None = None) -> Column:
    """Prior of a domain; a domain or tier that isn't listed counts as normal."""
    tiers = SETTINGS.source_tiers if tiers is None else tiers
    out = F.lit(TIER_PRIOR["normal"])
    for tier in ("high", "low"):
        listed = [d for d, t in tiers.items() if t == tier]
        if listed:
            out = F.when(domain.isin(listed), TIER_PRIOR[tier]).otherwise(out)
    return out


def synthesize_trust(rubric: Column, prior: Column, corroboration: Column, s: Settings = SETTINGS) -> Column:
    return F.least(F.greatest(s.trust_rubric * rubric + s.trust_prior * prior + s.trust_corroboration * corroboration, F.lit(0.0)), F.lit(1.0))


def safe_percent(part: Column, whole: Column) -> Column:
    """Whole percent, halves to the even neighbour, 0 of nothing."""
    return F.when(whole == 0, 0).otherwise(F.bround(part * 100 / whole)).cast("long")


def item_trust(domain: Column) -> Column:
    """Trust of a row of the items view; null without a rubric."""
    rubric = score_rubric(F.col("primary_source"), F.col("has_links"), F.col("has_numbers"), F.col("balance"), F.col("marketing"))
    return F.when(F.col("has_rubric"), synthesize_trust(rubric, source_prior(domain), corroboration_score(F.col("corroboration_count"))))


NETLOC_SQL = "regexp_extract(source_url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"
DOMAIN_SQL = f"regexp_replace(lower({NETLOC_SQL}), '^www\\.', '')"
PRIOR_SQL = f"CASE WHEN {DOMAIN_SQL} IN ({', '.join(repr(d) for d in SETTINGS.source_tiers)}) THEN 1.0 ELSE 0.5 END"
RUBRIC_SQL = """(CASE WHEN primary_source THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN has_links THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN has_numbers THEN 0.2::DOUBLE ELSE 0 END
  + CASE balance WHEN 'balanced' THEN 0.2::DOUBLE WHEN 'mixed' THEN 0.1::DOUBLE ELSE 0 END + CASE marketing WHEN 'low' THEN 0.15::DOUBLE WHEN 'medium' THEN 0.07::DOUBLE ELSE 0 END)"""
TRUST_SQL = f"CASE WHEN has_rubric THEN least(1.0, 0.6::DOUBLE * {RUBRIC_SQL} + 0.2::DOUBLE * ({PRIOR_SQL}) + 0.2::DOUBLE * least(coalesce(corroboration_count, 0), 3) / 3) END"
