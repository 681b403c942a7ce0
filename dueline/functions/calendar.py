"""Business-day arithmetic (Monday to Friday) in closed form.

Days are numbered from Monday 1900-01-01, so ``n % 7`` is the weekday with
Monday as 0, and ``5 * (n div 7) + least(n % 7, 5)`` counts the working days
before day ``n``. Divisions round down, so days before 1900 are right as well.
Everything stays inside generated code, without Python. Public holidays
(``Holidays``) are told from two constant arrays: how many of them lie before a
day, and before a workday's number; so they cost two lookups by place, and neither
a join nor a loop.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

_FRIDAY = 4


def _div(a: Column, b: int) -> Column:
    """Whole quotient, rounded down for negative numbers too."""
    return F.call_function("div", a - _mod(a, b), F.lit(b))


def _mod(a: Column, b: int) -> Column:
    return F.pmod(a, F.lit(b))


def _int(value: Column | int) -> Column:
    return value.cast("int") if isinstance(value, Column) else F.lit(value)


def day_number(moment: Column) -> Column:
    return F.date_diff(moment.cast("date"), F.lit("1900-01-01").cast("date"))


def _workdays_before(n: Column) -> Column:
    return _div(n, 7) * 5 + F.least(_mod(n, 7), F.lit(5))


def _counts_below(ordered: list[int], place: Column) -> Column:
    """How many of these numbers are below a place: one lookup in a constant array."""
    first, last = ordered[0], ordered[-1]
    below, done = [], 0
    for n in range(first, last + 2):
        while done < len(ordered) and ordered[done] < n:
            done += 1
        below.append(done)
    # Folded to one literal when the query is planned.
    table = F.split(F.lit(",".join(map(str, below))), ",").cast("array<int>")
    inside = F.greatest(F.lit(0), F.least(place - first, F.lit(len(below) - 1)))
    return F.element_at(table, (inside + 1).cast("int"))


class Holidays:
    """Days off besides weekends, at most ``MOST_YEARS`` years from first to last."""

    MOST_YEARS = 200

    def __init__(self, dates: Iterable[date]):
        start = date(1900, 1, 1)
        days = sorted({(d - start).days for d in dates})
        self.days = [n for n in days if n % 7 <= _FRIDAY]
        if self.days and self.days[-1] - self.days[0] > 366 * self.MOST_YEARS:
            raise ValueError(f"holidays over more than {self.MOST_YEARS} years")

    def before(self, n: Column) -> Column:
        """Holidays before day ``n``."""
        return _counts_below(self.days, n) if self.days else F.lit(0)

    def skipped(self, place: Column) -> Column:
        """Holidays before the workday that has ``place`` workdays before it, holidays left out."""
        if not self.days:
            return F.lit(0)
        workdays = [5 * (n // 7) + min(n % 7, 5) - i for i, n in enumerate(self.days)]
        return _counts_below(workdays, place + 1)


_NONE = Holidays([])


def _business_days_before(n: Column, holidays: Holidays) -> Column:
    return _workdays_before(n) - holidays.before(n)


def _time_of_day(moment: Column) -> Column:
    return moment - moment.cast("date").cast("timestamp_ntz")


def add_days(moment: Column, days: Column) -> Column:
    """Whole days later; keeps the time of day and the zone-free type."""
    return moment + F.make_dt_interval(days.cast("int"))


def minus_business_days(moment: Column, count: Column | int, holidays: Holidays = _NONE) -> Column:
    """``count`` business days earlier, time of day kept.

    Workdays are numbered in turn, and the workdays before a day give its
    number, on a day off that of the workday after it. So no days at all from a
    weekend gives that Monday, and one day the Friday.
    """
    n = day_number(moment)
    place = _business_days_before(n, holidays) - _int(count)
    w = (place + holidays.skipped(place)).cast("int")
    return add_days(moment, _div(w, 5) * 7 + _mod(w, 5) - n)


def workday_steps(moment: Column, deadline: Column) -> Column:
    """Most business days that can be taken off ``deadline`` without passing
    ``moment``; negative if it lies behind the deadline."""
    too_late = _time_of_day(moment) > _time_of_day(deadline)
    day = day_number(moment) + F.when(too_late, 1).otherwise(0)
    return (_workdays_before(day_number(deadline)) - _workdays_before(day)).cast("int")


def business_days_between(start: Column, end: Column, holidays: Holidays = _NONE) -> Column:
    """Workdays in [start, end); if end is earlier, minus those in (end, start]."""
    a, b = day_number(start), day_number(end)

    def before(n: Column) -> Column:
        return _business_days_before(n, holidays)

    return F.when(b >= a, before(b) - before(a)).otherwise(before(b + 1) - before(a + 1)).cast("int")


def business_days_left(moment: Column, deadline: Column, holidays: Holidays = _NONE) -> Column:
    """Steps of one workday from ``moment`` that fit before ``deadline``.

    The range keeps the time of day of its start, so the last day counts only
    if its clock time is not before the start's. An end on a day off is drawn back
    to the last workday when the start is a workday. An empty range gives -1.
    """
    a, b = day_number(moment), day_number(deadline)
    begun, ended = _business_days_before(a, holidays), _business_days_before(b + 1, holidays)
    late = F.when(_time_of_day(moment) > _time_of_day(deadline), 1).otherwise(0)
    on_workday = _business_days_before(a + 1, holidays) > begun
    days = F.when(on_workday, ended - late).otherwise(_business_days_before(b + 1 - late, holidays)) - begun
    return (F.greatest(days, F.lit(0)) - 1).cast("int")


def friday_on_or_after(moment: Column) -> Column:
    """First Friday not before the date; null stays null."""
    return add_days(moment, (F.lit(_FRIDAY + 7) - _mod(day_number(moment), 7)) % 7)
