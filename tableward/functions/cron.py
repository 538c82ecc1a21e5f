"""Five-field cron schedules as sets of minutes, hours, days, months and weekdays."""

from __future__ import annotations

from dataclasses import dataclass

# Field name -> (lowest, highest); Sunday is 0, and 7 as well.
LIMITS = {"minutes": (0, 59), "hours": (0, 23), "days": (1, 31), "months": (1, 12), "weekdays": (0, 7)}


@dataclass(frozen=True)
class Schedule:
    minutes: tuple[int, ...]
    hours: tuple[int, ...]
    days: tuple[int, ...]
    months: tuple[int, ...]
    weekdays: tuple[int, ...]
    any_day: bool
    any_weekday: bool


def _values(text: str, low: int, high: int) -> tuple[int, ...]:
    found: set[int] = set()
    for part in text.split(","):
        span, _, step = part.partition("/")
        first, _, last = span.partition("-")
        if span == "*":
            start, stop = low, high
        else:
            start = int(first)
            stop = int(last) if last else (high if step else start)
        if not low <= start <= stop <= high or (step and int(step) < 1):
            raise ValueError(f"{part!r} is outside {low}..{high}")
        found.update(range(start, stop + 1, int(step or 1)))
    return tuple(sorted(found))


def parse(expression: str) -> Schedule | None:
    """The sets of an expression, or None when it is no valid schedule."""
    fields = expression.split()
    if len(fields) != 5:
        return None
    try:
        sets = {name: _values(text, *LIMITS[name]) for name, text in zip(LIMITS, fields)}
    except ValueError:
        return None
    sets["weekdays"] = tuple(sorted({d % 7 for d in sets["weekdays"]}))
    return Schedule(**sets, any_day=len(sets["days"]) == 31, any_weekday=len(sets["weekdays"]) == 7)
