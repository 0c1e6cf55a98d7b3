"""Declared dataset contracts and the checks that turn violations into rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """Raised by the fail-closed wrappers, with the issue rows attached."""

    def __init__(self, issues):
        self.issues = issues
        super().__init__("; ".join(f"{i['dataset']}.{i['code']}: {i['subject']} ({i['violations']})" for i in issues))


@dataclass(frozen=True)
class Col:
    kind: str                      # string, date, boolean, numeric
    nullable: bool = False
    finite: bool = True


@dataclass(frozen=True)
class Contract:
    name: str
    columns: dict[str, Col]
    key: tuple[str, ...]


S, D, B, N = Col("string"), Col("date"), Col("boolean"), Col("numeric")
Sn, Dn, Bn, Nn = Col("string", True), Col("date", True), Col("boolean", True), Col("numeric", True)


def _contract(name, key, **columns):
    return Contract(name, columns, tuple(key.split()))


CONTRACTS = {c.name: c for c in (
    _contract("security_master", "security_id", security_id=S, ticker=S, company_name=S, exchange=S,
              security_type=S, sector=S, sub_industry=S),
    _contract("universe_membership", "date security_id", date=D, security_id=S, eligible=B, exclusion_reason=Sn),
    _contract("semiconductor_classification", "security_id", security_id=S, ticker=S, company_name=S,
              subsector=S, classification_notes=S),
    _contract("peer_classification", "security_id", security_id=S, subsector=S, peer_group=S, classification_notes=S),
    _contract("daily_panel", "date security_id", date=D, security_id=S, adjusted_close=N, close=N, volume=N,
              **{"return": Nn}),
    _contract("peer_membership", "date security_id peer_id peer_definition", date=D, security_id=S, peer_id=S,
              peer_definition=S, weight=N),
    _contract("relative_returns", "date security_id peer_definition", date=D, security_id=S, peer_definition=S,
              stock_return=Nn, peer_return=Nn, relative_return=Nn, market_adjusted_return=Nn,
              semiconductor_adjusted_return=Nn),
    _contract("events", "event_id", event_id=S, date=D, security_id=S, direction=S, relative_return=N,
              relative_volatility=N, threshold_used=N, peer_definition=S, subsector=S, volume=Nn, market_cap=Nn,
              simultaneous_event_group=Sn, corporate_action_type=S, earnings_flag=B, news_identified_flag=B),
    _contract("event_panel", "event_id relative_day return_specification", event_id=S, event_date=D, security_id=S,
              relative_day=N, calendar_date=Dn, direction=S, peer_definition=S, return_specification=S,
              initiator_return=Nn, peer_return=Nn, signed_initiator_return=Nn, signed_peer_return=Nn,
              valid_observation=B, event_date_peer_membership_valid=B),
    _contract("event_outcomes", "event_id horizon return_specification", event_id=S, event_date=D, security_id=S,
              direction=S, peer_definition=S, subsector=S, horizon=N, return_specification=S, initiator_car=Nn,
              peer_car=Nn, peer_catchup=Nn, initiator_reversal=Nn, convergence=Nn, initial_relative_shock=N,
              relative_volatility=N, simultaneous_event_group=Sn, earnings_flag=Bn,
              overlapping_post_event_window=B, valid_horizon=B, missing_reason=Sn),
)}

NUMERIC_TYPES = ("tinyint", "smallint", "int", "bigint", "float", "double")


def _kind_matches(kind: str, dtype: str) -> bool:
    if kind == "numeric":
        return dtype in NUMERIC_TYPES or dtype.startswith("decimal")
    if kind == "date":
        return dtype in ("date", "timestamp_ntz", "timestamp")
    return dtype == kind


def issue_rows(df: DataFrame, counters: dict[tuple[str, str], "F.Column"], dataset: str) -> DataFrame:
    """Evaluate counters in one aggregate pass and keep the non-zero ones as rows."""
    names = list(counters)
    totals = df.agg(*[F.coalesce(c.cast("bigint"), F.lit(0)).alias(f"c{i}") for i, c in enumerate(counters.values())])
    entries = F.array(*[F.struct(F.lit(code).alias("code"), F.lit(subject).alias("subject"),
                                 F.col(f"c{i}").alias("violations")) for i, (code, subject) in enumerate(names)])
    return (totals.select(F.inline(entries)).where("violations > 0")
            .select(F.lit(dataset).alias("dataset"), "code", "subject", "violations"))


def contract_issues(df: DataFrame, contract: Contract) -> DataFrame:
    """dataset, code, subject, violations: every broken general rule, none repaired."""
    types = dict(df.dtypes)
    counters = {}
    absent = sorted(set(contract.columns) - set(types))
    if absent:
        counters[("missing_columns", ",".join(absent))] = F.max(F.lit(len(absent)))
    for name, spec in contract.columns.items():
        if name not in types:
            continue
        c = F.col(name)
        hole = (c.isNull() | F.isnan(c)) if types[name] in ("double", "float") else c.isNull()
        if not spec.nullable:
            counters[("null_values", name)] = F.count_if(hole)
        if not _kind_matches(spec.kind, types[name]):
            counters[("invalid_type", name)] = F.max(F.lit(1))
            continue
        if spec.kind == "string":
            counters[("blank_string", name)] = F.count_if(F.length(F.trim(c)) == 0)
        elif spec.kind == "date" and types[name] != "date":
            counters[("invalid_date", name)] = F.count_if(c != F.date_trunc("day", c))
        elif spec.kind == "numeric" and spec.finite and types[name] in ("double", "float"):
            counters[("non_finite", name)] = F.count_if(F.abs(c) == F.lit(float("inf")))
    general = issue_rows(df, counters, contract.name)
    if set(contract.key) <= set(types):
        general = general.unionByName(duplicate_issues(df, contract))
    return general


def duplicate_issues(df: DataFrame, contract: Contract) -> DataFrame:
    groups = df.groupBy(*contract.key).agg(F.count("*").alias("__n")).where("__n > 1")
    return issue_rows(groups, {("duplicate_primary_key", ",".join(contract.key)): F.sum("__n")}, contract.name)


def require(issues: DataFrame) -> None:
    """Raise with all issue rows; a handful of rows by construction (one per rule)."""
    found = issues.collect()
    if found:
        raise ContractError([r.asDict() for r in found])
