"""Column roles of an event log."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(name: str) -> Column:
    """Column by its exact name; names may hold dots, colons and blanks."""
    return F.col("`" + name.replace("`", "``") + "`")


@dataclass(frozen=True)
class EventLogSpec:
    """Which column plays which role.

    ``order_by`` puts the events of one case in sequence and has to be unique
    inside a case: a Spark table has no row order of its own. It defaults to
    the timestamp alone.

    ``long_case_events`` is the number of events up to which one case is left
    to a single task. Longer cases are cut into ranges (see ``CaseLog``).
    """

    case: str = "case:concept:name"
    activity: str = "concept:name"
    timestamp: str | None = "time:timestamp"
    resource: str | None = "org:resource"
    deadline: str | None = "deadline"
    order_by: tuple[str, ...] = ()
    numeric: tuple[str, ...] = ()
    dynamic: tuple[str, ...] = ()
    static: tuple[str, ...] = ()
    long_case_events: int = 1_000_000

    def __post_init__(self) -> None:
        if not self.order_by:
            if self.timestamp is None:
                raise ValueError("a log without timestamp needs order_by")
            object.__setattr__(self, "order_by", (self.timestamp,))

    @property
    def order(self) -> list[Column]:
        return [col(name) for name in self.order_by]

    @property
    def order_key(self) -> Column:
        """The ordering columns as one comparable value."""
        if len(self.order_by) == 1:
            return col(self.order_by[0])
        return F.struct(*self.order)

    def but(self, **changes) -> EventLogSpec:
        return replace(self, **changes)

    def missing(self, columns: list[str]) -> list[str]:
        """Names this spec uses that ``columns`` lacks."""
        named = [self.case, self.activity, self.timestamp, *self.order_by]
        return [n for n in dict.fromkeys(named) if n is not None and n not in columns]


def _known(spec: EventLogSpec, name: str) -> Column:
    return F.when(col(name).isNotNull(), spec.order_key)


def first_value(spec: EventLogSpec, name: str) -> Column:
    """Aggregate: first non-null value in event order."""
    if name == spec.order_by[0]:
        return F.min(col(name))
    return F.min_by(col(name), _known(spec, name))


def last_value(spec: EventLogSpec, name: str) -> Column:
    """Aggregate: last non-null value in event order."""
    if name == spec.order_by[0]:
        return F.max(col(name))
    return F.max_by(col(name), _known(spec, name))
