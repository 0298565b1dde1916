"""Driver-side configuration of an evaluation."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields, replace

from ..functions import terms


@dataclass(frozen=True)
class Lexicon:
    """Every list may be replaced as a whole."""

    kitchen: list[str] = field(default_factory=lambda: terms.KITCHEN)
    interior: list[str] = field(default_factory=lambda: terms.INTERIOR)
    fitout: list[str] = field(default_factory=lambda: terms.FITOUT)
    portfolio: list[str] = field(default_factory=lambda: terms.PORTFOLIO)
    showroom: list[str] = field(default_factory=lambda: terms.SHOWROOM)
    designer: list[str] = field(default_factory=lambda: terms.DESIGNER)
    architect: list[str] = field(default_factory=lambda: terms.ARCHITECT)
    developer: list[str] = field(default_factory=lambda: terms.DEVELOPER)
    individual_markers: list[str] = field(default_factory=lambda: terms.INDIVIDUAL_MARKERS)
    business_markers: list[str] = field(default_factory=lambda: terms.BUSINESS_MARKERS)
    high_precision: list[str] = field(default_factory=lambda: terms.HIGH_PRECISION)
    mid_precision: list[str] = field(default_factory=lambda: terms.MID_PRECISION)
    business_intent: list[str] = field(default_factory=lambda: terms.BUSINESS_INTENT)
    negative: list[str] = field(default_factory=lambda: terms.NEGATIVE)
    hard_negative: list[str] = field(default_factory=lambda: terms.HARD_NEGATIVE)
    cities: list[str] = field(default_factory=lambda: terms.CITIES)


@dataclass(frozen=True)
class ScoringConfig:
    mode: str = "precision"
    relevant: int = 70
    maybe_low: int = 45
    lexicon: Lexicon = field(default_factory=Lexicon)
    has_email: int = 3
    has_phone: int = 4
    has_whatsapp: int = 2
    ksa_bonus: int = 12
    non_ksa_penalty: int = -35
    hp_max: int = 35
    mp_max: int = 18
    biz_max: int = 15
    density_max: int = 20
    negative_max: int = -35
    penalty_gov_edu: int = -80
    penalty_article: int = -35
    penalty_marketplace: int = -35
    penalty_retail_catalog: int = -25

    def __post_init__(self):
        mode = (self.mode or "precision").strip().lower()
        if mode not in ("precision", "recall"):
            raise ValueError(f"unknown mode: {mode}")
        object.__setattr__(self, "mode", mode)

    def with_lexicon(self, **lists: list[str]) -> ScoringConfig:
        return replace(self, lexicon=replace(self.lexicon, **lists))


def load_env(path: str) -> dict[str, str]:
    """KEY=VALUE lines of a file into the environment, where the key is not set yet; what was set is returned."""
    added: dict[str, str] = {}
    if not os.path.exists(path):
        return added
    with open(path, encoding="utf-8") as f:
        for line in map(str.strip, f):
            if not line or line.startswith("#") or "=" not in line:
                continue
            key, value = (x.strip() for x in line.split("=", 1))
            if key and key not in os.environ:
                added[key] = os.environ[key] = value.strip("\"'")
    return added


@dataclass(frozen=True)
class RunRequest:
    """A run's parameters. Negative limits and unknown modes are refused; a blank mode is none."""

    run_name: str | None = None
    mode: str = "google"
    evaluator_mode: str | None = None
    sources: tuple[str, ...] = ()
    queries: tuple[str, ...] = ()
    cities: tuple[str, ...] = ()
    max_leads: int = 2000
    max_pages: int = 20
    global_concurrency: int = 6
    dedupe: bool = True

    def __post_init__(self):
        mode = (self.evaluator_mode or "").strip().lower() or None
        if mode not in (None, "precision", "recall"):
            raise ValueError("evaluator_mode must be precision or recall")
        object.__setattr__(self, "evaluator_mode", mode)
        for f in fields(self):
            if f.name.startswith("max_") or f.name == "global_concurrency":
                if getattr(self, f.name) < 0:
                    raise ValueError(f"{f.name} must not be negative")
