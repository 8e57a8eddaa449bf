"""Capability manifests: tools and policies of JSON documents as dimensions, refused whole if any part is unsound."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The effects that a tool may have, what a control may do, and bounds on a document.
EFFECTS, ENFORCEMENTS = ("read", "write", "delete", "execute", "egress"), ("blocking", "advisory")
MOST_ENTRIES, MOST_CHARS, MOST_ARGS, MOST_EFFECTS = 10_000, 256, 64, 16


class ManifestError(ValueError):
    """A manifest that is refused whole."""


class Manifest(NamedTuple):
    tools: DataFrame
    policies: DataFrame


def _kind(path: str) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_variant_get(F.try_parse_json("spec"), path, "variant")), F.lit("VOID"))


def _entries(text: DataFrame, key: str, name: str, required: bool) -> DataFrame:
    """(name, spec) of the object at key, spec as JSON text."""
    whole = text.select(F.col("value").alias("spec"))
    allowed = _kind(f"$.{key}").startswith("OBJECT")
    if not required:
        allowed = allowed | (_kind(f"$.{key}") == "VOID")
    if not whole.where(~(_kind("$").startswith("OBJECT") & allowed)).isEmpty():
        raise ManifestError(f"a manifest is an object, and so are its {key}")
    entries = F.from_json(F.get_json_object("spec", f"$.{key}"), "map<string,string>")
    if not whole.where(F.size(entries) > MOST_ENTRIES).isEmpty():
        raise ManifestError(f"a manifest has at most {MOST_ENTRIES} {key}")
    return whole.select(F.explode(entries).alias(name, "spec"))


def _refuse(rows: DataFrame, sound: Column, name: str) -> None:
    bad = rows.where(~F.coalesce(sound, F.lit(False))).select(name).first()
    if bad is not None:
        raise ManifestError(f"{bad[0]!r} is unsound")


def _short(path: str) -> Column:
    return (_kind(path) == "VOID") | ((_kind(path) == "STRING") & (F.length(F.get_json_object("spec", path)) <= MOST_CHARS))


def _named(name: str) -> Column:
    return F.length(name).between(1, MOST_CHARS) & _kind("$").startswith("OBJECT")


def load(text: DataFrame) -> Manifest:
    """tools (tool_id, effect, effects, reversible, destination, requires_approval, sensitive_args) and policies (policy_id,
    enforcement, description) of JSON documents (value), which are bounded one by one and refused together.

    Types are taken as they are: the text "false" is no flag, and a list with one bad entry is no list. effect is the class
    of the gravest effect. What has no default, as a policy's enforcement, is not guessed. A document that is not JSON, or
    has a key twice, is refused.
    """
    texts = lambda path: F.from_json(F.get_json_object("spec", path), "array<string>")
    given = _entries(text, "tools", "tool_id", True)
    effects, args = texts("$.effects"), F.coalesce(texts("$.sensitive_args"), F.array().cast("array<string>"))
    sound = (
        _named("tool_id") & (_kind("$.effects") == "ARRAY<STRING>") & F.size(effects).between(1, MOST_EFFECTS) & F.forall(effects, lambda e: e.isin(*EFFECTS))
        & _kind("$.reversible").isin("BOOLEAN", "VOID") & _short("$.destination") & _kind("$.requires_approval").isin("BOOLEAN", "VOID")
        & _kind("$.sensitive_args").isin("ARRAY<STRING>", "ARRAY<VOID>", "VOID") & (F.size(args) <= MOST_ARGS) & F.forall(args, lambda a: F.length(a) <= MOST_CHARS)
    )
    _refuse(given, sound, "tool_id")
    flag = lambda path: F.get_json_object("spec", path) == "true"
    gravest = F.when(F.array_contains(effects, "egress"), "egress").when(F.arrays_overlap(effects, F.array(*map(F.lit, ("write", "delete", "execute")))), "state_change").otherwise("read_only")
    tools = given.select(
        "tool_id", gravest.alias("effect"), F.array_sort(F.array_distinct(effects)).alias("effects"), flag("$.reversible").alias("reversible"), F.get_json_object("spec", "$.destination").alias("destination"),
        F.coalesce(flag("$.requires_approval"), F.lit(False)).alias("requires_approval"), args.alias("sensitive_args"),
    )
    said = _entries(text, "policies", "policy_id", False)
    enforcement = F.get_json_object("spec", "$.enforcement")
    _refuse(said, _named("policy_id") & (_kind("$.enforcement") == "STRING") & enforcement.isin(*ENFORCEMENTS) & _short("$.description"), "policy_id")
    return Manifest(tools, said.select("policy_id", enforcement.alias("enforcement"), F.coalesce(F.get_json_object("spec", "$.description"), F.lit("")).alias("description")))
