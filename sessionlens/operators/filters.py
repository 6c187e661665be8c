"""The shared filter: facets of the owning session, an event-time window, the findings axis."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlens.functions.text import or_unknown
from sessionlens.schema import FACETS, PLANES, STREAM, UNKNOWN

SESSION_FACETS = list(FACETS.values())
PRESET_DAYS = {"24h": 1, "7d": 7, "30d": 30, "all": None}


class UnknownFilterValue(ValueError):
    """A filter value outside the vocabulary; ``allowed`` holds what would be accepted.

    ``allowed`` is a list for the fixed sets and a one-column DataFrame for values found in the
    data, which may be too many to hold on the driver.
    """

    def __init__(self, name: str, value: object, allowed: list[str] | DataFrame):
        super().__init__(f"filter '{name}' value '{value}' is not in the vocabulary")
        self.name, self.value, self.allowed = name, value, allowed


@dataclass(frozen=True)
class Filter:
    start: int | None = None
    end: int | None = None
    schema: str | None = None
    model: str | None = None
    preset: str | None = None
    harnessVersion: str | None = None
    provider: str | None = None
    role: str | None = None

    def facets(self) -> dict[str, str]:
        return {f: getattr(self, f) for f in FACETS if getattr(self, f) is not None}

    @property
    def active(self) -> bool:
        return bool(self.facets()) or self.start is not None or self.end is not None


NO_FILTER = Filter()


@dataclass(frozen=True)
class Tables:
    """The stored tables a question is asked of."""

    sessions: DataFrame
    steps: DataFrame | None = None
    calls: DataFrame | None = None
    findings: DataFrame | None = None
    evidence: DataFrame | None = None


def facet_equals(column: Column, value: str) -> Column:
    """``unknown`` selects NULL as well as the literal."""
    return (or_unknown(column) if value == UNKNOWN else column) == value


def in_window(time: Column, start: int | None, end: int | None) -> Column:
    """Inclusive at both ends; a row without a time is outside any bounded window."""
    inside = F.lit(True)
    if start is not None:
        inside = inside & (time >= start)
    if end is not None:
        inside = inside & (time <= end)
    return inside


def facet_condition(filter: Filter) -> Column:
    ok = F.lit(True)
    for name, value in filter.facets().items():
        ok = ok & facet_equals(F.col(FACETS[name]), value)
    return ok


def filter_sessions(sessions: DataFrame, filter: Filter = NO_FILTER) -> DataFrame:
    return sessions.where(facet_condition(filter)
                          & in_window(F.col("started_at"), filter.start, filter.end))


def apply_facets(rows: DataFrame, sessions: DataFrame, filter: Filter,
                 time: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of matching sessions inside the window of their own time.

    The join is left out when no facet is asked for and no session column is kept: every row has a
    session, so it could not drop any.
    """
    rows = rows.where(in_window(F.col(time), filter.start, filter.end))
    if not filter.facets() and not keep:
        return rows
    owners = sessions.where(facet_condition(filter)).select(
        *STREAM, *[F.col(c).alias(f"s_{c}") for c in keep])
    return rows.join(owners, STREAM, "inner" if keep else "left_semi")


def apply_axis(findings: DataFrame, plane: str | None = None, detector: str | None = None,
               code: str | None = None, session: str | None = None) -> DataFrame:
    for column, value in (("plane", plane), ("detector", detector), ("code", code)):
        if value is not None:
            findings = findings.where(facet_equals(F.col(column), value))
    if session is not None:
        findings = findings.where(F.col("session_id") == session)
    return findings


def observed(calls: DataFrame) -> DataFrame:
    return calls.where(~F.col("outcome_only"))


# the root column each table's window applies to
def findings_in(t: Tables, f: Filter = NO_FILTER, keep: tuple[str, ...] = ()) -> DataFrame:
    return apply_facets(t.findings, t.sessions, f, "occurred_at", keep)


def calls_in(t: Tables, f: Filter = NO_FILTER, keep: tuple[str, ...] = ()) -> DataFrame:
    return apply_facets(observed(t.calls), t.sessions, f, "started_at", keep)


def steps_in(t: Tables, f: Filter = NO_FILTER, keep: tuple[str, ...] = ()) -> DataFrame:
    return apply_facets(t.steps, t.sessions, f, "started_at", keep)


# --- vocabulary and validation ----------------------------------------------------------------

def vocabulary(t: Tables) -> DataFrame:
    """Every value a filter may take, ``(facet, value)``, never filtered itself.

    One pass per table: each row offers all its facet values and duplicates combine map-side.
    """
    by_session = t.sessions.select(F.explode(F.array(*[
        F.struct(F.lit(name).alias("facet"), or_unknown(F.col(column)).alias("value"))
        for name, column in FACETS.items()])).alias("v")).select("v.*")
    by_finding = t.findings.select(F.explode(F.array(
        F.struct(F.lit("code").alias("facet"), or_unknown(F.col("code")).alias("value")),
        F.struct(F.lit("detector").alias("facet"), F.col("detector").alias("value")))
    ).alias("v")).select("v.*")
    return by_session.unionByName(by_finding).distinct()


def allowed_values(t: Tables, name: str) -> list[str] | DataFrame:
    if name == "plane":
        return list(PLANES)
    if name == "session":
        return t.sessions.select(F.col("session_id").alias("value")).distinct().orderBy("value")
    return vocabulary(t).where(F.col("facet") == name).select("value").orderBy("value")


def require_known(t: Tables, name: str, value: str | None) -> None:
    """Raise unless the value exists, compared as written. Probes for one matching row."""
    if value is None:
        return
    if name == "plane":
        known = value in PLANES
    elif name == "session":
        known = not t.sessions.where(F.col("session_id") == value).limit(1).isEmpty()
    elif name in ("code", "detector"):
        known = not t.findings.where(facet_equals(F.col(name), value)).limit(1).isEmpty()
    else:
        known = not t.sessions.where(facet_equals(F.col(FACETS[name]), value)).limit(1).isEmpty()
    if not known:
        raise UnknownFilterValue(name, value, allowed_values(t, name))


def validate_filter(t: Tables, filter: Filter) -> None:
    for name, value in filter.facets().items():
        require_known(t, name, value)


def preset_window(name: str, now_millis: int) -> Filter:
    """A rolling window ending now; ``all`` leaves both ends open."""
    if name not in PRESET_DAYS:
        raise UnknownFilterValue("window", name, list(PRESET_DAYS))
    days = PRESET_DAYS[name]
    if days is None:
        return NO_FILTER
    return Filter(start=now_millis - days * 86_400_000, end=now_millis)


def without_facet(filter: Filter, axis: str) -> Filter:
    """The facet being grouped on does not narrow the groups."""
    return replace(filter, **{axis: None})
