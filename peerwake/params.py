"""Parameter records. Values become literals in the logical plan.

Each field states its own interval or choices in its metadata; ``_Checked`` tests them all and lists
every fault at once. Rules between fields are in ``_clashes``.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field, fields

# Names of outcomes, cells and peer definitions in the result tables.
OUTCOMES = ("convergence", "peer_catchup", "initiator_reversal")
CELL = ("horizon", "return_specification", "peer_definition")
ECONOMIC = "economic_subsector_peers"
BROAD = "broad_semiconductor_peers"
CORRELATION = "trailing_return_similarity_peers"
EVERYONE = "*"

# Corporate-action labels and cooldown scopes that inputs may carry.
ACTION_TYPES = ("none", "split", "merger", "abnormal_price_adjustment", "unknown")
COOLDOWN_SCOPES = ("none", "firm", "peer_group", "both")

SMALL_SAMPLE = 30


def signature(params) -> str:
    """Short digest of a parameter record, stable under key order."""
    body = json.dumps(asdict(params), sort_keys=True, default=str)
    return hashlib.sha256(body.encode()).hexdigest()[:16]


def _span(default, least: float = -math.inf, most: float = math.inf, open_ends: bool = False):
    """A number within [least, most], or strictly between them."""
    inside = (lambda x: least < x < most) if open_ends else (lambda x: least <= x <= most)
    return field(default=default, metadata={"ok": inside, "wants": f"{'between' if open_ends else 'from'} {least:g} {'and' if open_ends else 'to'} {most:g}"})


def _choice(default, allowed: tuple):
    return field(default=default, metadata={"ok": lambda x: x in allowed, "wants": f"one of {allowed}"})


def _names(default: tuple, allowed: tuple | None = None, filled: bool = True):
    """Distinct names, drawn from ``allowed`` where that is given."""
    def ok(xs):
        return bool(xs or not filled) and len({*xs}) == len(xs) and (allowed is None or {*xs} <= {*allowed})
    return field(default=default, metadata={"ok": ok, "wants": "distinct names" + (f" out of {allowed}" if allowed else "") + ", at least one" * filled})


class _Checked:
    def __post_init__(self):
        faults = [f"{f.name}={getattr(self, f.name)!r}, wanted {f.metadata['wants']}" for f in fields(self)
                  if f.metadata and not f.metadata["ok"](getattr(self, f.name))]
        if faults := faults or list(self._clashes()):
            raise ValueError(f"{type(self).__name__}: " + "; ".join(faults))

    def _clashes(self) -> Iterator[str]:
        """Faults between fields that are right by themselves."""
        return iter(())


@dataclass(frozen=True)
class Detection(_Checked):
    minimum_relative_move: float = _span(0.05, 0)
    volatility_window: int = _span(60, 2)
    threshold_multiplier: float = _span(3.0, 0)
    cooldown_period: int = _span(5, 0)
    minimum_peer_count: int = _span(3, 1)
    minimum_history_requirement: int = _span(60, 2)
    cooldown_scope: str = _choice("firm", COOLDOWN_SCOPES)
    exclude_corporate_action_types: tuple[str, ...] = _names(ACTION_TYPES[1:], ACTION_TYPES, filled=False)

    def _clashes(self):
        if self.minimum_history_requirement > self.volatility_window:
            yield f"a window of {self.volatility_window} rows never holds {self.minimum_history_requirement}"


@dataclass(frozen=True)
class Study(_Checked):
    primary_horizons: tuple[int, ...] = _names((1, 5))
    descriptive_horizons: tuple[int, ...] = _names((3, 10), filled=False)
    pre_event_days: int = _span(5, 0)
    post_event_days: int = _span(10, 1)

    def _clashes(self):
        if beyond := [h for h in self.horizons if not 1 <= h <= self.post_event_days]:
            yield f"horizons {beyond} lie outside days 1 to {self.post_event_days}"

    @property
    def horizons(self) -> tuple[int, ...]:
        return tuple(sorted({*self.primary_horizons, *self.descriptive_horizons}))


@dataclass(frozen=True)
class Universe(_Checked):
    universe_version: str = "v1"
    allowed_universe_tiers: tuple[str, ...] = _names(("core",))
    min_price: float = _span(5.0, 0)
    min_history_days: int = _span(252, 0)
    min_average_dollar_volume: float = _span(1_000_000.0, 0)
    average_dollar_volume_window_days: int = _span(20, 1)
    allowed_exchange_or_markets: tuple[str, ...] = ()
    us_exchanges: tuple[str, ...] = ("NASDAQ", "NYSE")
    eligible_security_types: tuple[str, ...] = ("common_stock", "adr")
    allow_adrs: bool = True
    classification_snapshot_date: str | None = None
    allow_classification_before_as_of: bool = False
    eligibility_start_date: str | None = None
    eligibility_end_date: str | None = None

    def _clashes(self):
        if self.classification_snapshot_date is None and not self.allow_classification_before_as_of:
            yield "without a snapshot date, labels can't be told from later knowledge"
        if self.eligibility_start_date and self.eligibility_end_date and self.eligibility_end_date < self.eligibility_start_date:
            yield f"the sample ends ({self.eligibility_end_date}) before it starts ({self.eligibility_start_date})"


@dataclass(frozen=True)
class Inference(_Checked):
    confidence_level: float = _span(0.95, 0, 1, open_ends=True)
    interval_method: str = _choice("analytical", ("analytical", "bootstrap"))
    trim_proportion: float = field(default=0.10, metadata={"ok": lambda x: 0 <= x < 0.5, "wants": "under a half from each end"})
    bootstrap_iterations: int = _span(2_000, 100)
    random_seed: int = 42
    cluster_by: str | None = _choice("firm", (None, "firm", "event_date", "two_way"))

    def _clashes(self):
        if (self.interval_method, self.cluster_by) == ("bootstrap", "two_way"):
            yield "rows are drawn by one cluster at a time, so intervals by two need interval_method='analytical'"


@dataclass(frozen=True)
class Resampling(_Checked):
    random_peer_iterations: int = _span(500, 1)
    pseudo_event_iterations: int = _span(500, 1)
    null_iterations: int = _span(1_000, 1)
    bootstrap_iterations: int = _span(2_000, 1)
    date_block_length: int = _span(5, 1)
    confidence_level: float = _span(0.95, 0, 1, open_ends=True)
    pseudo_event_exclusion_days: int = _span(10, 0)
    match_columns: tuple[str, ...] = _names(("subsector", "volatility_regime", "market_regime", "liquidity_bucket"))
    random_seed: int = 42
