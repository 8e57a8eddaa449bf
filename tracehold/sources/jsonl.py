"""JSON lines of telemetry: strict reading with one reject code per bad line, the reject ledger, and the record view."""

from __future__ import annotations

import json
import math
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tracehold.operators import anchors
from tracehold.sources.shared import kept, shared_dir

# Reject codes in the order in which they are tested, and their bounds.
CODES = ("LINE_EXCEEDS_MAX_BYTES", "LINE_NOT_VALID_UTF8", "NESTING_EXCEEDS_MAX_DEPTH", "MALFORMED_JSON", "NOT_A_JSON_OBJECT", "RECORD_EXCEEDS_MAX_KEYS")
MAX_BYTES, MAX_DEPTH, MAX_KEYS, MAX_DIGITS = 4_194_304, 64, 512, 1024
LEDGER_ROWS = 1000
MAX_IDENTITY, MAX_RESPONSE = 256, 200_000
#: The fields of a record whose types are told.
FIELDS = (
    "event_type", "session_id", "trace_id", "span_id", "tool_name", "event_id", "host", "user", "agent_name", "framework", "timestamp", "reversible", "data",
    "data.response_text", "data.reversible", "data.has_injection_patterns", "data.injection_patterns",
)


class ReadError(ValueError):
    """The rejects of a run are over its budget."""


def _depth(line: str) -> int:
    """Deepest nesting of brackets outside of strings."""
    depth = deepest = 0
    inside = escaped = False
    for ch in line:
        if inside:
            if escaped:
                escaped = False
            elif ch == "\\":
                escaped = True
            elif ch == '"':
                inside = False
        elif ch == '"':
            inside = True
        elif ch in "[{":
            depth += 1
            deepest = max(deepest, depth)
        elif ch in "]}":
            depth -= 1
    return deepest


def _once(pairs: list) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ValueError("a key occurs twice")
    return out


def _refused(text: str) -> None:
    raise ValueError(f"{text} is no JSON number")


def _finite(text: str) -> float:
    value = float(text)
    if not math.isfinite(value):
        raise ValueError("the number overflows")
    return value


def _whole(text: str) -> int:
    if len(text.lstrip("-")) > MAX_DIGITS:
        raise ValueError("the number is too long")
    return int(text)


_decoder = json.JSONDecoder(object_pairs_hook=_once, parse_constant=_refused, parse_float=_finite, parse_int=_whole)


def reject_code(line: str | None) -> str | None:
    """None for an acceptable line."""
    if line is None:
        return CODES[3]
    if len(line) * 4 > MAX_BYTES and len(line.encode("utf-8", "surrogatepass")) > MAX_BYTES:
        return CODES[0]
    if line.count("[") + line.count("{") > MAX_DEPTH and _depth(line) > MAX_DEPTH:
        return CODES[2]
    try:
        value = _decoder.decode(line)
    except (ValueError, RecursionError):
        return CODES[3]
    if not isinstance(value, dict):
        return CODES[4]
    return CODES[5] if len(value) > MAX_KEYS else None


@F.pandas_udf(StringType())
def json_reject_code(line: pd.Series) -> pd.Series:
    return line.map(reject_code)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, source, arrival) of the non-blank lines of text files; arrival orders lines within the run."""
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_name").alias("source"), F.monotonically_increasing_id().alias("arrival"))
    return lines.where(F.trim("line") != "")


def looked_up(line: Column, key: str) -> Column:
    """A field's value in the envelope where it is not null, else in the data bag."""
    return F.coalesce(F.get_json_object(line, f"$.{key}"), F.get_json_object(line, f"$.data.{key}"))


def written_lines(lines: DataFrame) -> str:
    """The folder that lines (value) are written to as text, in the folder that the cluster shares."""
    path = f"{shared_dir(lines.sparkSession)}/lines/{uuid.uuid4().hex}"
    lines.write.text(path)
    return path


VERDICT = "session_id string, events long, started_at double, agent string, host string, severity string, n_findings long, rules string, completeness double, evidence_status string, sequence long"


def write_verdicts(rows: DataFrame) -> str:
    """Writes rows (VERDICT) as JSON lines in order of sequence, range by range, and returns their folder."""
    names = [c.split()[0] for c in VERDICT.split(", ")]
    return written_lines(rows.select("sequence", F.to_json(F.struct(*names)).alias("value")).repartitionByRange("sequence").sortWithinPartitions("sequence").select("value"))


def read_verdicts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(VERDICT).json(path)


def quarantined(lines: DataFrame) -> DataFrame:
    """lines (line) with reject_code, null where accepted. Encoding is tested on the bytes; a line may hold U+FFFD."""
    text = F.when(F.is_valid_utf8("line") & (F.octet_length("line") <= MAX_BYTES), F.col("line")).otherwise("")
    code = F.when(F.octet_length("line") > MAX_BYTES, CODES[0]).when(~F.is_valid_utf8("line"), CODES[1]).when(F.col("line").isNull(), CODES[3]).otherwise(json_reject_code(text))
    return lines.withColumn("reject_code", code)


def ledger(lines: DataFrame, rows: int = LEDGER_ROWS) -> DataFrame:
    """The first rejected lines by arrival: source, arrival, code, digest, bytes."""
    bad = lines.where("reject_code IS NOT NULL")
    return bad.orderBy("arrival").limit(rows).select("source", "arrival", "reject_code", F.substring(F.sha2("line", 256), 1, 16).alias("digest"), F.octet_length("line").cast("long").alias("bytes"))


def report(lines: DataFrame) -> DataFrame:
    n, bad = F.count("*"), F.count("reject_code")
    return lines.agg((n - bad).alias("accepted"), bad.alias("rejected"), F.round(F.coalesce(bad / F.nullif(n, F.lit(0)), F.lit(0.0)), 6).alias("ratio"), *(F.count_if(F.col("reject_code") == c).alias(c.lower()) for c in CODES))


def gate(counts: DataFrame, most: int | None = None, ratio: float | None = None) -> DataFrame:
    """counts of report(), unless over the budget: then the run fails before anything is written."""
    row = counts.first()
    if most is not None and row["rejected"] > most or ratio is not None and row["accepted"] + row["rejected"] >= 100 and row["ratio"] > ratio:
        raise ReadError(f"{row['rejected']} of {row['accepted'] + row['rejected']} lines were rejected")
    return counts


def record_view(lines: DataFrame, most_response: int = MAX_RESPONSE) -> DataFrame:
    """Accepted lines as checked fields; a wrong type becomes null and a defect code, and never fails the record.

    Identities of over MAX_IDENTITY characters are absent, never cut, as two would become one; a response is cut at
    most_response, with a defect, as it is read for its meaning. A list of markers is read whole or not at all. A flag is
    true, false, or no answer; text that looks like one is none. defects are distinct, in the order of the fields. A line
    is parsed once for all of its fields.
    """
    raw = lambda path: F.get_json_object("line", f"$.{path}")
    kinds = {path: f"_kind_{n}" for n, path in enumerate(FIELDS)}
    rows = lines.withColumn("_parsed", F.try_parse_json("line"))
    rows = rows.withColumns({name: F.coalesce(F.schema_of_variant(F.try_variant_get("_parsed", f"$.{path}", "variant")), F.lit("VOID")) for path, name in kinds.items()})
    kind = lambda path: F.col(kinds[path])
    said = lambda path: F.try_variant_get("_parsed", f"$.{path}", "string")  # noqa: E731  (of what is known to be a string)
    defects: list[Column] = []

    def text(key: str, code: str, longest: str | None = None) -> Column:
        is_text = kind(key) == "STRING"
        defects.append(F.when(~kind(key).isin("STRING", "VOID"), code))
        defects.append(F.when(is_text & (F.length(said(key)) > MAX_IDENTITY), longest or code))
        return F.when(is_text & F.length(said(key)).between(1, MAX_IDENTITY), said(key))

    def flag(path: str, code: str) -> Column:
        defects.append(F.when(~kind(path).isin("BOOLEAN", "VOID"), code))
        return F.when(kind(path) == "BOOLEAN", F.try_variant_get("_parsed", f"$.{path}", "boolean"))

    fields = {
        "event_type": text("event_type", "INVALID_EVENT_TYPE"), "session_id": text("session_id", "INVALID_SESSION_KEY_TYPE"), "trace_id": text("trace_id", "INVALID_SESSION_KEY_TYPE"),
        "span_id": text("span_id", "INVALID_SPAN_TYPE", "SPAN_EXCEEDS_MAX_CHARS"), "tool_name": text("tool_name", "INVALID_TOOL_NAME_TYPE", "TOOL_NAME_EXCEEDS_MAX_CHARS"),
        "event_id": text("event_id", "INVALID_EVENT_ID_TYPE"), **{key: text(key, "INVALID_IDENTITY_FIELD_TYPE") for key in ("host", "user", "agent_name", "framework")},
    }
    number = raw("timestamp").try_cast("double")
    good = (kind("timestamp") != "BOOLEAN") & (number > 0) & (number < float("inf"))
    defects.append(F.when(raw("timestamp").isNotNull() & ~F.coalesce(good, F.lit(False)), "INVALID_TIMESTAMP"))
    fields |= {"ts": F.when(good, number), "reversible": flag("reversible", "INVALID_REVERSIBLE_TYPE")}
    defects.append(F.when(~(kind("data").startswith("OBJECT") | (kind("data") == "VOID")), "INVALID_DATA_BAG_TYPE"))
    response = said("data.response_text")
    spoken = kind("data.response_text") == "STRING"
    defects.append(F.when(~kind("data.response_text").isin("STRING", "VOID"), "INVALID_RESPONSE_TEXT_TYPE"))
    defects.append(F.when(spoken & (F.length(response) > most_response), "RESPONSE_TEXT_TRUNCATED"))
    fields["response_text"] = F.when(spoken & (F.length(response) > 0), F.substring(response, 1, most_response))
    fields["reversible"] = F.coalesce(flag("data.reversible", "INVALID_REVERSIBLE_TYPE"), fields["reversible"])
    fields["has_injection_patterns"] = flag("data.has_injection_patterns", "INVALID_SCANNER_CLAIM")
    listed = F.from_json(raw("data.injection_patterns"), "array<string>")
    whole = kind("data.injection_patterns").isin("ARRAY<STRING>", "ARRAY<VOID>") & F.forall(listed, lambda x: F.trim(x) != "")
    defects.append(F.when((kind("data.injection_patterns") != "VOID") & ~F.coalesce(whole, F.lit(False)), "INVALID_INJECTION_MARKERS"))
    fields["injection_patterns"] = F.when(whole, listed)
    return rows.withColumns(fields | {"defects": F.array_distinct(F.array_compact(F.array(*defects)))}).drop("_parsed", *kinds.values())


def session_keys(records: DataFrame) -> DataFrame:
    """records with session_key, key_kind and confidence: session, trace, anonymous window (to be folded) or isolated."""
    anonymous = F.col("ts").isNotNull() & F.coalesce("host", "user", "agent_name").isNotNull()
    kind = F.when(F.col("session_id").isNotNull(), "session").when(F.col("trace_id").isNotNull(), "trace").when(anonymous, "anonymous").otherwise("isolated")
    confidence = F.when(kind == "session", 1.0).when(kind == "trace", 0.9).when(kind == "anonymous", 0.3).otherwise(0.0)
    scope = F.substring(F.sha2(F.concat_ws("\x1f", *(F.coalesce(c, F.lit("")) for c in ("host", "user", "agent_name"))), 256), 1, 32)
    key = F.when(kind == "session", F.col("session_id")).when(kind == "trace", F.col("trace_id")).when(kind == "anonymous", F.concat(F.lit("anon-"), scope)).otherwise(F.concat(F.lit("isolated-"), "arrival"))
    return records.withColumns({"key_kind": kind, "session_key": key, "confidence": confidence})


def anonymous_windows(records: DataFrame, width: float = 300.0) -> DataFrame:
    """(scope, ts, window_start): windows anchored at their first event; one opens when an event is over width later.

    Windows of a busy scope are found by doubling pointers between its instants, not by walking it.
    """
    instants = kept(records.where("ts IS NOT NULL AND NOT isnan(ts)").select("scope", "ts").distinct(), "instants")
    starts = anchors.beginnings(instants, "scope", width, True)
    return anchors.governed(instants, starts, "scope", width).withColumnRenamed("start", "window_start")
