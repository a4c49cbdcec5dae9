"""Expressions over the state of a scan and of a request."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The stored phase marker and the name it is shown under.
SHOWN = {"gather": "gathering", "burst": "classifying", "finalize": "finalizing"}
#: The steps of the checklist and the phases that belong to each.
STEPS = [["starting", "loading_models", "fingerprint"], ["discovering"], ["scoring", "gathering", "classifying"], ["finalizing"]]
#: Labels that a user may give.
LABELS = ["high", "elevated", "watch", "safe"]


def shown_phase(phase: Column, running: Column, marker: Column) -> Column:
    """While scoring runs, the phase of a live marker; otherwise the phase as it is."""
    live = F.lit("scoring")
    for stored, shown in SHOWN.items():
        live = F.when(marker == stored, shown).otherwise(live)
    return F.when(running & (phase == "scoring"), live).otherwise(phase)


def classified(shown: Column, total: Column, pending: Column) -> Column:
    """Posts classified so far; null until the total of this scan is known."""
    return F.when(shown.isin("classifying", "finalizing") & pending.isNotNull(), F.greatest(total - pending, F.lit(0)))


def step_index(phase: Column) -> Column:
    """The checklist step of a phase; the first for phases outside the checklist."""
    out = F.lit(0)
    for i, phases in enumerate(STEPS):
        out = F.when(phase.isin(phases), i).otherwise(out)
    return out


def dashboard(running: Column, scored: Column, not_assessed: Column, started: Column) -> Column:
    return F.when(running | (scored > 0) | (not_assessed > 0), "results").when(started.isNotNull(), "all-clear").otherwise("welcome")


def listed(did: Column, names: Column) -> Column:
    """Whether a comma-separated list names the id."""
    return F.array_contains(F.transform(F.split(names, ","), lambda name: F.trim(name)), did)


def allowed(did: Column, names: Column) -> Column:
    """An empty list allows everyone."""
    return (F.trim(names) == "") | listed(did, names)


def admin(did: Column, names: Column) -> Column:
    """An empty list names no one."""
    return (names != "") & listed(did, names)


def effective_user(own: Column, is_admin: Column, as_user: Column) -> Column:
    """The user whose data a request reads; null where the request is refused."""
    return F.when(as_user.isNull(), own).when(is_admin, as_user)


def polls(before: Column, now: Column) -> Column:
    """Results are read again while a scan runs and once after it; accuracy once after it."""
    ended = before & ~now
    return F.struct((now | ended).alias("results"), ended.alias("accuracy"))


def user_label(raw: Column) -> Column:
    """The label in lower case; null for any other word."""
    low = F.lower(raw)
    return F.when(low.isin(LABELS), low)


def bounded(value: Column, default: int, low: int, high: int) -> Column:
    """A setting as a whole number between its bounds; the default where it is missing or no number."""
    number = F.coalesce(F.try_to_number(F.trim(value), F.lit("S999999999")).cast("long"), F.lit(default))
    return F.least(F.greatest(number, F.lit(low)), F.lit(high))
