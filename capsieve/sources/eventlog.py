"""Event log: JSON event lines between human-readable lines, for batch and streaming frames alike."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capsieve.functions.binding import strict_json
from capsieve.functions.labels import PHASES

# Required fields per event kind.
REQUIRED = {
    "engine_start": ("engine", "device"),
    "progress": ("engine", "index", "total", "video_path"),
    "run_dir": ("path",),
    "done": ("run_dir",),
    "error": ("phase", "reason"),
    "candidate_failed": ("phase", "reason", "video_path", "sample_id"),
}
OPTIONAL = {"error": ("video_path", "sample_id")}
NUMERIC = ("index", "total")
FIELDS = ("engine", "device", "index", "total", "video_path", "path", "run_dir", "phase", "reason", "sample_id")


def _member(value: Column) -> Column:
    """STRUCT<kind, text> of a member; a null reads as the word None, booleans as True and False."""
    text, kind = F.try_variant_get(value, "$", "string"), F.schema_of_variant(value)
    shown = F.when(kind == "VOID", "None").when(kind == "BOOLEAN", F.initcap(text)).otherwise(text)
    return F.struct(kind.alias("kind"), shown.alias("text"))


def _integer(member: Column) -> Column:
    """Numbers lose their fraction, text must be a whole number, booleans are 0 and 1.

    Numbers outside 64 bits take the nearest bound; beyond 32 digits they are no number, and the line no event.
    """
    text, kind = member["text"], member["kind"]
    number = (
        F.when(kind == "BOOLEAN", F.when(text == "True", "1").otherwise("0"))
        .when(kind == "STRING", F.nullif(F.regexp_extract(text, r"^\s*([+-]?\d+)\s*$", 1), F.lit("")))
        .otherwise(text)
        .try_cast("decimal(38,6)")
    )
    bound = lambda n: F.lit(n).cast("decimal(38,6)")
    return F.when(number.isNotNull(), F.least(F.greatest(number, bound(-(2**63))), bound(2**63 - 1)).cast("bigint"))


def parse_lines(lines: DataFrame) -> DataFrame:
    """Adds ``event`` (null for a human line) and the event's fields to ``run_id, line_no, value`` rows.

    A line is parsed once, into a map of its members.
    """
    doc = F.when(F.col("value").rlike(r"\A\s*\{"), strict_json(F.col("value")))
    members = F.transform_values(F.try_variant_get(doc, "$", "map<string,variant>"), lambda _, v: _member(v))
    # Exploding one element keeps later filters above the parse, which would be repeated below them.
    read = lines.select(*lines.columns, F.explode(F.array(members)).alias("_members"))
    read = read.withColumns({f"_m_{f}": F.try_element_at("_members", F.lit(f)) for f in ("event", *FIELDS)})
    parsed = read.withColumns(
        {
            "_kind": F.when(F.col("_m_event.kind") == "STRING", F.col("_m_event.text")),
            **{f"_{f}": _integer(F.col(f"_m_{f}")) if f in NUMERIC else F.col(f"_m_{f}.text") for f in FIELDS},
            **{f"_{f}_null": F.col(f"_m_{f}.kind") == "VOID" for f in ("video_path", "sample_id")},
        }
    )

    def complete(kind: str) -> Column:
        checks = [F.col(f"_{f}").isNotNull() for f in REQUIRED[kind]]
        if "phase" in REQUIRED[kind]:
            checks.append(F.col("_phase").isin(*PHASES))
        return (F.col("_kind") == kind) & reduce(lambda a, b: a & b, checks)

    valid = reduce(lambda a, b: a | b, [complete(k) for k in REQUIRED])
    parsed = parsed.withColumn("event", F.when(valid, F.col("_kind")))

    def field(name: str) -> Column:
        kinds = [k for k in REQUIRED if name in REQUIRED[k] or name in OPTIONAL.get(k, ())]
        value = F.col(f"_{name}")
        if name in ("video_path", "sample_id"):
            value = F.when((F.col("event") == "error") & F.col(f"_{name}_null"), None).otherwise(value)
        return F.when(F.col("event").isin(*kinds), value)

    done = parsed.select(*lines.columns, F.inline(F.array(F.struct("event", *[field(f).alias(f) for f in FIELDS]))))
    return done


def events(lines: DataFrame) -> DataFrame:
    return parse_lines(lines).filter("event IS NOT NULL").drop("value")


def plain_lines(lines: DataFrame) -> DataFrame:
    return parse_lines(lines).filter("event IS NULL").select(*lines.columns)
