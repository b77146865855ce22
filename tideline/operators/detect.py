"""Detection rules over service windows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.text import duration_literal, fingerprint, micros
from tideline.operators.windows import replay_windows
from tideline.schema import DETECTION, RULE


@dataclass(frozen=True)
class Rule:
    """One rule. The id is part of every incident's fingerprint."""

    id: str = "error_rate"
    name: str = "elevated error rate"
    kind: str = "error_rate"
    window: timedelta = timedelta(seconds=60)
    threshold: float = 0.5
    min_events: int = 5
    incident_severity: str = "error"

    def row(self) -> dict:
        return {
            "id": self.id, "name": self.name, "kind": self.kind, "window_us": micros(self.window),
            "threshold": float(self.threshold), "min_events": self.min_events,
            "incident_severity": self.incident_severity, "window_text": duration_literal(self.window),
        }


def error_rate(judged: DataFrame) -> DataFrame:
    """Fires on at least ``min_events`` events of which at least ``threshold`` are errors."""
    rate = F.col("errors") / F.col("total")
    percent = F.bround(rate * 100, 0).cast("long")
    fires = (F.col("total") >= F.col("min_events")) & (rate >= F.col("threshold"))
    title = F.concat(
        F.col("name"), F.lit(": "), percent, F.lit("% error rate on "), F.col("service_name"), F.lit(" ("),
        F.col("errors"), F.lit(" of "), F.col("total"), F.lit(" events over "), F.col("window_text"), F.lit(")"),
    )
    details = F.to_json(F.struct(
        F.col("errors").alias("error_count"), rate.alias("error_rate"), "kind", F.col("id").alias("rule_id"),
        "threshold", F.col("total").alias("total_events"), F.col("window_text").alias("window"),
    ))
    # A stream's window struct carries its watermark along.
    carried = [c for c in judged.columns if c == "window"]
    return judged.filter(fires).select(
        *carried, "tick", F.col("id").alias("rule_id"), "tenant_id", "service_name",
        fingerprint(F.col("id"), F.col("tenant_id"), F.col("service_name")).alias("fingerprint"),
        title.alias("title"), F.col("incident_severity").alias("severity"),
        F.col("errors").alias("event_count"), F.col("new_errors").alias("new_event_count"), details.alias("details"),
    )


RULES: dict[str, Callable[[DataFrame], DataFrame]] = {"error_rate": error_rate}


def _rules_value(rules: Sequence[Rule]) -> Column:
    """The rules as one constant array of structs."""
    return F.array(*[
        F.struct(*[F.lit(r.row()[f.name]).cast(f.dataType).alias(f.name) for f in RULE.fields]) for r in rules
    ])


def evaluate_rules(events: DataFrame, rules: Sequence[Rule], step: timedelta, **replay) -> DataFrame:
    """Every rule at every tick: the windows a rule set needs come from one pass, each distinct lookback counted once.

    ``replay`` goes to ``replay_windows`` (mode, start, until).
    """
    wanted = {r.window for r in rules if r.kind in RULES}
    if not wanted:
        return events.sparkSession.createDataFrame([], DETECTION)
    return detect(replay_windows(events, sorted(wanted), step, **replay), rules)


def detect(windows: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Every rule against every service window of its own lookback; a kind nobody registered never fires.

    Rules are a constant of the plan: each window row meets those of its lookback in place, so there is
    neither a join nor a shuffle.
    """
    found = None
    for kind, judge in RULES.items():
        mine = [r for r in rules if r.kind == kind]
        if not mine:
            continue
        fitting = F.filter(_rules_value(mine), lambda r: r["window_us"] == F.col("window_us"))
        met = windows.select("*", F.explode(fitting).alias("_rule"))
        fired = judge(met.select(*[c for c in windows.columns if c != "window_us"], "_rule.*"))
        found = fired if found is None else found.unionByName(fired)
    return found if found is not None else windows.sparkSession.createDataFrame([], DETECTION)
