"""Run parameters. Every time-dependent operator takes ``as_of`` from here; none reads the clock."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime


@dataclass(frozen=True)
class Params:
    as_of: datetime = datetime(2001, 11, 15)
    confidence_threshold: float = 0.70
    high_confidence: float = 0.85
    stale_days: int = 30
    batch_size: int = 10
    accurate_model: str = "accurate"
    bulk_model: str = "bulk"
    daily_limits: dict[str, int] = field(default_factory=lambda: {"accurate": 1000, "bulk": 14400})
    default_daily_limit: int = 1000
    budget_reserve: int = 50
    per_minute: int = 30
    high_value_spend: int = 250_000
    inherit_factor: str = "0.9"
    unknown_code_cap: str = "0.4"
    correction_inherit_confidence: str = "0.95"
    uncertain_parent: str = "0.6"
    link_min_confidence: str = "0.5"
    cache_ttl_days: int = 30
    keep_reports: int = 30
    taxonomy_version: str = "v26.0801"
    taxonomy_min_codes: int = 100_000
    known_code: str = "43211507"
    currency: str = "USD"
