"""Deadline-aware event-log analytics written as Spark DataFrame jobs."""

from dueline.caselog import CaseLog
from dueline.spec import EventLogSpec

__all__ = ["CaseLog", "EventLogSpec"]
