"""Manifests, keyed scopes and tagged numbers."""

from __future__ import annotations

import hashlib
import hmac
import json

import pytest

from tracehold.functions import canonical
from tracehold.plans import intake
from tracehold.sources import jsonl, manifest

TOOL = {"effects": ["read", "egress"], "reversible": False, "destination": "x", "requires_approval": True, "sensitive_args": ["to"]}


def _load(spark, document):
    text = document if isinstance(document, str) else json.dumps(document)
    return manifest.load(spark.createDataFrame([(text,)], "value string"))


def test_a_manifest_is_read_whole(spark):
    found = _load(spark, {"tools": {"t": TOOL, "u": {"effects": ["delete", "read"]}, "v": {"effects": ["read"]}}, "policies": {"p": {"enforcement": "blocking", "description": "d"}}})
    tools = {r.tool_id: r.asDict() for r in found.tools.collect()}
    assert tools["t"] == {"tool_id": "t", "effect": "egress", "effects": ["egress", "read"], "reversible": False, "destination": "x", "requires_approval": True, "sensitive_args": ["to"]}
    assert (tools["u"]["effect"], tools["u"]["reversible"], tools["u"]["requires_approval"], tools["v"]["effect"]) == ("state_change", None, False, "read_only")
    assert [tuple(r) for r in found.policies.collect()] == [("p", "blocking", "d")]
    assert _load(spark, {"tools": {}}).policies.count() == 0


@pytest.mark.parametrize(
    "document",
    [
        "{", "[]", "{}", {"tools": []}, {"tools": {"": TOOL}}, {"tools": {"t" * 257: TOOL}}, {"tools": {"t": 1}}, {"tools": {"t": TOOL | {"effects": []}}}, {"tools": {"t": TOOL | {"effects": ["fly"]}}}, {"tools": {"t": TOOL | {"effects": [["read"]]}}},
        {"tools": {"t": TOOL | {"effects": "read"}}}, {"tools": {"t": TOOL | {"reversible": "false"}}}, {"tools": {"t": TOOL | {"requires_approval": "false"}}}, {"tools": {"t": TOOL | {"sensitive_args": 0}}}, {"tools": {"t": TOOL | {"sensitive_args": ["a"] * 65}}},
        {"tools": {"t": TOOL | {"destination": 5}}}, {"tools": {"t": TOOL}, "policies": []}, {"tools": {"t": TOOL}, "policies": {"p": {}}}, {"tools": {"t": TOOL}, "policies": {"p": {"enforcement": "maybe"}}}, {"tools": {"t": TOOL}, "policies": {"p": {"enforcement": "blocking", "description": 1}}},
        '{"tools": {"t": {"effects": ["read"]}, "t": {"effects": ["egress"]}}}',
    ],
)
def test_a_manifest_with_any_unsound_part_is_refused(spark, document):
    with pytest.raises(manifest.ManifestError):
        _load(spark, document)


def test_bounds_hold_per_document(spark):
    """Tools beyond a document's bound, and names that come twice, are in further documents."""
    document = lambda n, at=0: (json.dumps({"tools": {f"t{k + at}": {"effects": ["read"]} for k in range(n)}}),)
    load = lambda *documents: manifest.load(spark.createDataFrame(documents, "value string")).tools.count()
    assert load(document(manifest.MOST_ENTRIES), document(5, manifest.MOST_ENTRIES), document(1)) == manifest.MOST_ENTRIES + 6
    with pytest.raises(manifest.ManifestError):
        load(document(1), document(manifest.MOST_ENTRIES + 1))


def test_all_suppliers_are_tools_of_a_manifest(spark, tmp_path):
    """More suppliers than a document may have, each name twice."""
    made = spark.range(0, 2 * manifest.MOST_ENTRIES + 3).selectExpr("id AS s_suppkey", "'S' || (id DIV 2) AS s_name")
    made.write.parquet(str(tmp_path / "supplier.parquet"))
    spark.createDataFrame([(0, "A"), (1, "B")], "n_nationkey int, n_name string").write.parquet(str(tmp_path / "nation.parquet"))
    found = intake.manifest_file_tools(spark, str(tmp_path))
    assert found.groupBy("tool_id").count().count() == manifest.MOST_ENTRIES + 2 and found.count() == 2 * manifest.MOST_ENTRIES + 3


def test_policies_do_not_depend_on_the_number_of_tools(spark, tmp_path):
    spark.range(0, manifest.MOST_ENTRIES + 1).selectExpr("id AS s_suppkey", "'S' || id AS s_name").write.parquet(str(tmp_path / "supplier.parquet"))
    spark.createDataFrame([(0, "A"), (1, "B"), (2, "B")], "n_nationkey int, n_name string").write.parquet(str(tmp_path / "nation.parquet"))
    assert sorted(map(tuple, intake.manifest_policies(spark, str(tmp_path)).collect())) == [("A", "blocking"), ("B", "advisory"), ("B", "blocking")]


def test_a_line_is_parsed_once(spark):
    lines = spark.createDataFrame([('{"session_id": "s", "timestamp": 5, "span_id": 1, "data": {"response_text": "r", "reversible": true}}',), ('{"host": "' + "h" * 300 + '", "reversible": "x"}',)], "line string")
    found = jsonl.record_view(lines)
    assert [tuple(r) for r in found.select("session_id", "ts", "response_text", "reversible", "defects").collect()] == [("s", 5.0, "r", True, ["INVALID_SPAN_TYPE"]), (None, None, None, None, ["INVALID_IDENTITY_FIELD_TYPE", "INVALID_REVERSIBLE_TYPE"])]
    assert found.select("defects")._jdf.queryExecution().optimizedPlan().toString().lower().count("parse_json") <= 1 and "_parsed" not in found.columns


def test_scopes_are_keyed_by_a_secret(spark):
    rows = spark.createDataFrame([("h\x1fu",), (None,), ("",)], "scope string")
    got = [r[0] for r in rows.select(canonical.keyed_scope(b"secret")("scope")).collect()]
    want = [None if s is None else hmac.new(b"secret", s.encode(), hashlib.sha256).hexdigest()[:32] for s in ("h\x1fu", None, "")]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_non_finite_numbers_are_tagged():
    assert json.loads(canonical.canonical({"a": [float("nan"), {"b": float("-inf")}], "c": 1.0})) == {"a": [{"nonfinite": "nan"}, {"b": {"nonfinite": "-inf"}}], "c": 1.0}
