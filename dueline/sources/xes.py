"""XES event logs as Spark tables.

One ``trace`` element is one input row of the XML reader, which opens plain
and gzip files. A gzip file is read by one task, so the events are spread anew
right after they leave their trace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dueline.functions.timing import to_zone_free

# XES attribute elements and the types they hold.
KINDS = {
    "string": "string",
    "date": "timestamp_ntz",
    "int": "long",
    "float": "double",
    "boolean": "boolean",
    "id": "string",
}
CASE_PREFIX = "case:"
EVENT_INDEX = "event_index"

_PAIRS = T.ArrayType(
    T.StructType([T.StructField("_key", T.StringType()), T.StructField("_value", T.StringType())])
)
_ATTRIBUTES = [T.StructField(k, _PAIRS) for k in KINDS]
TRACE_SCHEMA = T.StructType(
    [*_ATTRIBUTES, T.StructField("event", T.ArrayType(T.StructType(_ATTRIBUTES)))]
)


def _attribute_list(parent: str) -> Column:
    """All attributes of an element as (kind, _key, _value)."""

    def tagged(kind: str) -> Column:
        pairs = F.coalesce(F.col(f"{parent}{kind}"), F.array().cast(_PAIRS))
        return F.transform(
            pairs,
            lambda a: F.named_struct(
                F.lit("kind"), F.lit(kind), F.lit("key"), a["_key"], F.lit("value"), a["_value"]
            ),
        )

    return F.concat(*[tagged(kind) for kind in KINDS])


def _typed(text: Column, kind: str) -> Column:
    if kind == "date":
        # Wall clock time: a zone at the end is cut, not applied.
        return to_zone_free(F.regexp_replace(text, r"(Z|[+-]\d{2}:?\d{2})$", ""))
    return text.cast(KINDS[kind])


def attribute_kinds(events: DataFrame) -> dict[str, list[tuple[str, str]]]:
    """Names and their kinds, by level: one row per attribute name and kind.

    A name that stands with several kinds gets the narrowest that holds all its
    values: float for int and float, else string.
    """
    found = {}
    for level in ("trace", "event"):
        pairs = events.select(F.explode(f"_{level}").alias("a")).select("a.kind", "a.key")
        kinds: dict[str, set[str]] = {}
        for r in pairs.distinct().collect():
            kinds.setdefault(r["key"], set()).add(r["kind"])
        found[level] = sorted((key, common_kind(of)) for key, of in kinds.items())
    return found


def common_kind(kinds: set[str]) -> str:
    if len(kinds) == 1:
        return next(iter(kinds))
    return "float" if kinds == {"int", "float"} else "string"


def read_xes(
    spark: SparkSession,
    path: str,
    trace_attributes: dict[str, str] | None = None,
    event_attributes: dict[str, str] | None = None,
) -> DataFrame:
    """One row per event; trace attributes carry the prefix ``case:``.

    The attribute dicts map names to XES kinds. Without them the names are
    looked up first, which reads the file once more. ``event_index`` is the
    position in the file, for logs ordered by it rather than by time.
    """
    traces = spark.read.format("xml").option("rowTag", "trace").schema(TRACE_SCHEMA).load(path)
    events = traces.select(
        _attribute_list("").alias("_trace"), F.posexplode("event").alias(EVENT_INDEX, "_e")
    )
    events = events.select(EVENT_INDEX, "_trace", _attribute_list("_e.").alias("_event"))
    if trace_attributes is None or event_attributes is None:
        kinds = attribute_kinds(events)
        trace_attributes = trace_attributes or dict(kinds["trace"])
        event_attributes = event_attributes or dict(kinds["event"])
    # By trace name and position, so that one long trace does not stay together.
    events = events.repartition(F.xxhash64("_trace"), F.col(EVENT_INDEX))

    def pick(source: str, name: str, kind: str) -> Column:
        hits = F.filter(F.col(source), lambda a: a["key"] == name)
        return _typed(F.get(hits, F.lit(0))["value"], kind)

    columns = [pick("_event", n, k).alias(n) for n, k in event_attributes.items()]
    columns += [
        pick("_trace", n, k).alias(CASE_PREFIX + n) for n, k in trace_attributes.items()
    ]
    return events.select(EVENT_INDEX, *columns)
