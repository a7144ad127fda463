"""Column expressions: weights, decay, sizes, budgets, seeded order."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from stallrec import config as C


def _literal_map(values: Mapping, type_name: str) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(str(v)).cast(type_name))])


def event_weight(
    event: Column, weights: Mapping[str, float] = C.EVENT_WEIGHTS, unknown: float | None = 0
) -> Column:
    """Feedback weight of an event name; ``unknown=None`` leaves unlisted events null."""
    found = _literal_map(weights, "decimal(10,4)")[event]
    if unknown is None:
        return found
    return F.coalesce(found, F.lit(unknown).cast("decimal(10,4)"))


def days_before(as_of: dt.date, days: int) -> Column:
    return F.date_sub(F.lit(as_of), days).cast("timestamp")


def months_before(as_of: dt.date, months: int) -> Column:
    return F.add_months(F.lit(as_of), -months).cast("timestamp")


def recency_factor(ts: Column, as_of: dt.date) -> Column:
    """Step-wise time decay relative to ``as_of``."""
    expr = None
    for unit, count, factor in C.DECAY_STEPS:
        edge = days_before(as_of, count) if unit == "days" else months_before(as_of, count)
        value = F.lit(factor).cast("decimal(6,4)")
        expr = F.when(ts >= edge, value) if expr is None else expr.when(ts >= edge, value)
    return expr.otherwise(F.lit(C.DECAY_REST).cast("decimal(6,4)"))


def within_lookback(
    event: Column,
    ts: Column,
    as_of: dt.date,
    months: Mapping[str, int] = C.EVENT_MONTHS,
    default: int = C.DEFAULT_MONTHS,
) -> Column:
    """Per-event look-back. One ``ts`` bound holds for all events, so it reaches the scan."""
    by_months: dict[int, list[str]] = {}
    for name, m in months.items():
        by_months.setdefault(m, []).append(name)
    widest = max([default, *by_months])
    rule = ~event.isin(list(months)) & (ts >= months_before(as_of, default))
    for m, names in sorted(by_months.items()):
        rule = rule | (event.isin(names) & (ts >= months_before(as_of, m)))
    return (ts >= months_before(as_of, widest)) & rule


def whole_weeks(start: Column, end: Column) -> Column:
    return F.timestamp_diff("WEEK", start, end)


def floor_to(x: Column, step: int) -> Column:
    return (F.floor(x / step) * step).cast("double")


def integer_or(x: Column, default: int) -> Column:
    return F.coalesce(x.try_cast("bigint"), F.lit(default).cast("bigint"))


def whole_number(x: Column, kind: str = "string") -> Column:
    """A whole number from a number or from text with an optional sign, blanks around it or a
    fraction of zeros; null where it is none."""
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return x.cast("bigint")
    if kind in ("float", "double") or kind.startswith("decimal"):
        return F.when(x == F.floor(x), F.floor(x)).try_cast("bigint")
    text = F.trim(x.cast("string"))
    digits = F.regexp_extract(text, r"^([+-]?[0-9]+)([.]0*)?$", 1)
    return F.when(digits != "", digits).try_cast("bigint")


def size_number(
    size: Column,
    item_type: Column | None = None,
    default: float | None = None,
    letters: Mapping[str, float] = C.LETTER_SIZES,
    letters_by_type: Mapping[int, Mapping[str, float]] | None = None,
) -> Column:
    """Frame size text as a number: numeric text, else a letter, else ``default``."""
    text = F.upper(F.trim(size))
    choices = [F.regexp_replace(text, ",", ".").try_cast("double")]
    if item_type is not None:
        for t, table in (letters_by_type or {}).items():
            choices.append(F.when(item_type == t, _literal_map(table, "double")[text]))
    choices.append(_literal_map(letters, "double")[text])
    if default is not None:
        choices.append(F.lit(float(default)))
    return F.coalesce(*choices)


def budget_bounds(budget: Column, clean_open_end: bool = False) -> tuple[Column, Column]:
    """Lower and upper bound of a budget text.

    An open-ended text ("More than ...") keeps its thousands dots unless
    ``clean_open_end`` is set, so a dotted open end reads as a decimal fraction.
    """
    open_end = budget.startswith("More than")
    bare = F.replace(budget, F.lit("€"), F.lit(""))
    undotted = F.replace(bare, F.lit("."), F.lit(""))
    tail = F.replace(undotted if clean_open_end else bare, F.lit("More than "), F.lit(""))
    number = "decimal(38,0)"

    def part(i: int) -> Column:
        return F.trim(F.try_element_at(F.split(undotted, "-", 2), F.lit(i))).try_cast(number)

    low = F.when(open_end, F.trim(tail).try_cast(number)).otherwise(part(1))
    high = F.when(open_end, F.lit(C.MAX_PRICE_DEFAULT).cast(number)).otherwise(part(2))
    return (
        F.when(budget.isNotNull(), low).cast("double"),
        F.when(budget.isNotNull(), high).cast("double"),
    )


def seeded_order(*parts: Column, seed: int = 0) -> Column:
    """A repeatable stand-in for random order: the digest of key and seed."""
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts], F.lit(str(seed))))


def in_fraction(key: Iterable[Column], fraction: float, seed: int = 0) -> Column:
    """Membership in a repeatable random fraction, independent of the data layout."""
    head = F.conv(F.substring(seeded_order(*key, seed=seed), 1, 8), 16, 10).cast("bigint")
    return head < F.lit(int(round(fraction * 2**32)))


def price_band(price: Column, centre: Column, band: tuple[float, float] = C.PRICE_BAND) -> Column:
    return price.between(centre * F.lit(band[0]), centre * F.lit(band[1]))


def actor_key(user_id: Column, distinct_id: Column) -> Column:
    return F.when(user_id == 0, distinct_id).otherwise(user_id.cast("string"))
