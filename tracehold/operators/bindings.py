"""Approvals, receipts and sidecars: parsing, binding to calls, and validity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracehold.operators.detect import RECEIPT_TIERS

HEX64 = "^[0-9a-f]{64}$"
SIDECAR = "struct<scheme:string,stream_id:string,seq:long,prev:string,chain:string,key_id:string,sig:string,final:string>"
APPROVAL = "struct<decision:string,subject:struct<span_id:string,tool_id:string,arg_digest:string>,granted_at:double,expires_at:double,enforcement:string,nonce:string>"
RECEIPT = "struct<scheme:string,authority:string,kind:string,identifier:string,binding:struct<span_id:string,tool_id:string,arg_digest:string>,assurance:string>"
CONTROL = r"[\x00-\x1f\x7f]"


def digest_text(value: Column) -> Column:
    """A lower-case `sha256:` digest; no other form."""
    lower = F.lower(value)
    return F.when(value.startswith("sha256:") & F.substring(lower, 8, 64).rlike(HEX64) & (F.length(lower) == 71), lower)


def sidecars(rows: DataFrame, scheme: str) -> DataFrame:
    """rows (integrity JSON) with sidecar, is_chained, is_signed and defect; an unusable sidecar is null with a defect."""
    s = F.from_json("integrity", SIDECAR)
    rows = rows.withColumn("_s", s)
    sig = F.expr("try_to_binary(_s.sig, 'base64')")
    bad = (
        (F.col("_s.scheme") != scheme) | F.col("_s.scheme").isNull() | F.col("_s.stream_id").isNull() | F.col("_s.seq").isNull() | (F.col("_s.seq") < 0)
        | (F.col("_s.sig").isNotNull() & F.coalesce(F.octet_length(sig) != 64, F.lit(True))) | (F.col("_s.final").isNotNull() & (F.col("_s.final") != "true"))
    )
    bad = F.col("integrity").isNotNull() & F.coalesce(bad, F.lit(True))
    hexed = lambda c: F.when(F.col(f"_s.{c}").rlike(HEX64), F.col(f"_s.{c}"))
    kept = F.when(~bad & F.col("integrity").isNotNull(), F.struct("_s.stream_id", "_s.seq", hexed("prev").alias("prev"), hexed("chain").alias("chain"), "_s.key_id", "_s.sig", F.coalesce(F.col("_s.final") == "true", F.lit(False)).alias("final")))
    rows = rows.withColumns({"sidecar": kept, "defect": F.when(bad, "INVALID_INTEGRITY_OBJECT")}).drop("_s")
    return rows.withColumns({
        "is_chained": F.coalesce(F.col("sidecar.prev").isNotNull() & F.col("sidecar.chain").isNotNull(), F.lit(False)),
        "is_signed": F.coalesce(F.col("sidecar.sig").isNotNull() & F.col("sidecar.key_id").isNotNull(), F.lit(False)),
    })


def approvals(rows: DataFrame) -> DataFrame:
    """rows (approval JSON) with parsed fields; control characters or no span refuse the object, an unknown enforcement degrades."""
    rows = rows.withColumn("_a", F.from_json("approval", APPROVAL))
    fine = F.col("_a.decision").isin("allow", "deny") & F.col("_a.subject.span_id").isNotNull() & ~F.col("approval").rlike(CONTROL) & ~F.col("_a.subject.span_id").rlike(CONTROL)
    fine = F.coalesce(fine, F.lit(False))
    known = F.col("_a.enforcement").isin("blocking", "advisory")
    return rows.select(
        *(c for c in rows.columns if c != "_a"),
        F.when(fine, F.col("_a.decision")).alias("decision"), F.when(fine, F.col("_a.subject.span_id")).alias("span_id"), F.when(fine, F.col("_a.subject.tool_id")).alias("tool_id"),
        F.when(fine, digest_text(F.col("_a.subject.arg_digest"))).alias("arg_digest"), F.when(fine, F.col("_a.granted_at")).alias("granted_at"), F.when(fine, F.col("_a.expires_at")).alias("expires_at"),
        F.when(fine, F.when(F.coalesce(known, F.lit(False)), F.col("_a.enforcement")).otherwise("undeclared")).alias("enforcement"), F.when(fine, F.col("_a.nonce")).alias("nonce"),
        F.when(~fine & F.col("approval").isNotNull(), "INVALID_APPROVAL_OBJECT").alias("defect"),
    )


def approval_matches(calls: DataFrame, granted: DataFrame) -> DataFrame:
    """Approvals at the calls that they name by span: bound, bound_span_only or arg_mismatch; another tool is no match.

    calls: session_id, span_id, name, arg_digest, start_ts. granted: session_id, span_id, tool_id, arg_digest, decision,
    granted_at, expires_at, observed_at. Both may have verified positions (start_stream, start_seq; observed_stream,
    observed_seq): in one stream they tell whether the approval was there before the call started, else the clock does.
    """
    if "start_stream" not in calls.columns:
        calls = calls.withColumns({"start_stream": F.lit(None).cast("string"), "start_seq": F.lit(None).cast("long")})
    if "observed_stream" not in granted.columns:
        granted = granted.withColumns({"observed_stream": F.lit(None).cast("string"), "observed_seq": F.lit(None).cast("long")})
    g = granted.select("observed_stream", "observed_seq", *(c for c in ("assured", "tier") if c in granted.columns), "session_id", "span_id", "tool_id", F.col("arg_digest").alias("granted_digest"), "decision", "granted_at", "expires_at", "observed_at")
    both = calls.join(g, ["session_id", "span_id"]).where("tool_id IS NULL OR tool_id = name")
    binding = F.when(F.col("granted_digest") != F.col("arg_digest"), "arg_mismatch").when((F.col("granted_digest") == F.col("arg_digest")) & F.col("tool_id").isNotNull(), "bound").otherwise("bound_span_only")
    window = F.when(F.col("start_ts").isNull() | (F.col("granted_at").isNull() & F.col("expires_at").isNull()), F.lit(None)).otherwise(
        (F.coalesce("granted_at", F.lit(float("-inf"))) <= F.col("start_ts")) & (F.col("start_ts") <= F.coalesce("expires_at", F.lit(float("inf"))))
    )
    before = F.when(F.col("start_stream") == F.col("observed_stream"), F.col("observed_seq") < F.col("start_seq")).when(~F.isnan("observed_at") & ~F.isnan("start_ts"), F.col("observed_at") <= F.col("start_ts"))
    return both.withColumns({"binding": binding, "in_window": window.cast("boolean"), "observed_before": before.cast("boolean")})


def covering(matches: DataFrame) -> DataFrame:
    """The first approval in clock order that covers a call: allowed, exactly bound, not expired, observed before."""
    good = matches.where("decision = 'allow' AND binding = 'bound' AND observed_before AND coalesce(in_window, TRUE)")
    order = Window.partitionBy("session_id", "span_id").orderBy(F.col("observed_at").asc_nulls_last(), "granted_at", "expires_at")
    return good.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_nth")


#: What the approvals of a call come to, the first that holds.
APPROVAL_STATES = ("denied", "covered", "unassured", "arg_mismatch", "expired", "span_only", "none")


def approval_states(calls: DataFrame, matches: DataFrame, assured: Column | None = None) -> DataFrame:
    """calls (session_id, span_id) with approval, one of APPROVAL_STATES, from approval_matches() of them.

    assured: whether a match's approval is vouched for, where that is required; without it none needs to be.
    """
    fits = (F.col("decision") == "allow") & (F.col("binding") == "bound") & F.coalesce("observed_before", F.lit(False)) & F.coalesce("in_window", F.lit(True))
    rank = (
        F.when((F.col("decision") == "deny") & (F.col("binding") == "bound"), 1)
        .when(fits & (F.lit(True) if assured is None else assured), 2)
        .when(fits, 3)
        .when(F.col("binding") == "arg_mismatch", 4)
        .when(~F.col("in_window"), 5)
        .when(F.col("binding") == "bound_span_only", 6)
        .otherwise(7)
    )
    best = matches.groupBy("session_id", "span_id").agg(F.min(rank).alias("_rank"))
    names = F.array(*map(F.lit, APPROVAL_STATES))
    return calls.join(best, ["session_id", "span_id"], "left").withColumn("approval", F.element_at(names, F.coalesce("_rank", F.lit(7)))).drop("_rank")


#: The highest of RECEIPT_TIERS, as a place from 1 on, that a receipt's stated assurance allows.
CEILINGS = {"operation": 4, "object": 2, "client": 1}


def parsed_receipts(rows: DataFrame, scheme: str) -> DataFrame:
    """rows (receipt JSON) with receipt, assurance_unreadable and receipt_defect; null for what names no call.

    A receipt needs its scheme, authority, kind, identifier, and a binding that names something. An assurance that
    cannot be read leaves the receipt, but not its trust.
    """
    rows = rows.withColumn("_r", F.from_json("receipt", RECEIPT))
    short = lambda c: F.when(F.length(F.col(c)).between(1, 256), F.col(c))
    bound = F.struct(short("_r.binding.span_id").alias("span_id"), short("_r.binding.tool_id").alias("tool_id"), digest_text(F.col("_r.binding.arg_digest")).alias("arg_digest"))
    rows = rows.withColumn("_b", bound)
    named = F.coalesce("_b.span_id", "_b.tool_id", "_b.arg_digest").isNotNull()
    fine = F.coalesce((F.col("_r.scheme") == scheme) & short("_r.authority").isNotNull() & short("_r.kind").isNotNull() & short("_r.identifier").isNotNull() & named, F.lit(False))
    odd = F.col("_r.assurance").isNotNull() & ~F.col("_r.assurance").isin(*CEILINGS)
    made = F.struct("_r.authority", "_r.kind", "_r.identifier", F.col("_b").alias("binding"), F.when(~odd, F.col("_r.assurance")).alias("assurance"))
    return rows.withColumns({
        "receipt_defect": F.when(F.col("receipt").isNotNull() & (~fine | odd), "INVALID_RECEIPT_OBJECT"), "assurance_unreadable": fine & odd, "receipt": F.when(fine, made),
    }).drop("_r", "_b")


def receipt_binding(span_id: Column, name: Column, arg_digest: Column, contradicted: Column | None = None) -> Column:
    """How a parsed receipt binds to its call: null without one, else unbound, arg_mismatch, bound or bound_span_only."""
    b = F.col("receipt.binding")
    whole = b["span_id"].isNotNull() & b["tool_id"].isNotNull() & b["arg_digest"].isNotNull() & span_id.isNotNull() & arg_digest.isNotNull()
    return (
        F.when(F.col("receipt").isNull(), F.lit(None))
        .when((b["span_id"] != span_id) | (b["tool_id"] != name), "unbound")
        .when((F.lit(False) if contradicted is None else contradicted) | (b["arg_digest"] != arg_digest), "arg_mismatch")
        .when(whole, "bound")
        .otherwise("bound_span_only")
    )


def receipt_tier(binding: Column) -> Column:
    """The weaker of what the binding and the stated assurance support, as a place in RECEIPT_TIERS from 1 on."""
    stated = F.col("receipt.assurance")
    ceiling = F.when(F.col("assurance_unreadable"), 1).when(stated.isNull(), len(RECEIPT_TIERS))
    for name, rank in CEILINGS.items():
        ceiling = ceiling.when(stated == name, rank)
    return F.when(F.col("receipt").isNotNull(), F.least(F.when(binding == "bound", 2).otherwise(1), ceiling.otherwise(1)))


def dangling(granted: DataFrame, calls: DataFrame) -> DataFrame:
    """Approvals whose span no call has."""
    return granted.join(calls.select("session_id", "span_id").distinct(), ["session_id", "span_id"], "left_anti")


def arg_identity(declared: Column, recomputed: Column) -> Column:
    own = digest_text(declared)
    return (
        F.when(own.isNotNull() & recomputed.isNotNull(), F.when(own == recomputed, "declared_and_recomputed").otherwise("producer_contradicted"))
        .when(recomputed.isNotNull(), "recomputed").when(own.isNotNull(), "producer_declared").otherwise("none")
    )


# Where a provider's response holds its identifier, in order of preference: operation, authority, path, kind, assurance.
# A last part with a dash is a header, whose name is matched in either case.
RECEIPT_PATHS = (
    ("aws.s3.put_object", "aws:s3", "VersionId", "object_version", "operation"),
    ("aws.s3.put_object", "aws:s3", "ResponseMetadata.HTTPHeaders.x-amz-version-id", "object_version", "operation"),
    ("aws.s3.delete_object", "aws:s3", "VersionId", "delete_marker_version", "operation"),
    ("aws.s3.delete_object", "aws:s3", "ResponseMetadata.HTTPHeaders.x-amz-version-id", "delete_marker_version", "operation"),
    ("gcp.storage.upload", "gcp:storage", "generation", "object_generation", "operation"),
    ("azure.blob.upload", "azure:blob", "version_id", "blob_version", "operation"),
    ("azure.blob.upload", "azure:blob", "x-ms-version-id", "blob_version", "operation"),
    ("smtp.send", "smtp", "server_message_id", "message_id", "operation"),
    ("smtp.send", "smtp", "message-id", "client_message_id", "client"),
    ("smtp.send", "smtp", "message_id", "client_message_id", "client"),
    ("aws.ses.send_email", "aws:ses", "MessageId", "message_id", "operation"),
    ("sendgrid.send", "sendgrid", "headers.x-message-id", "message_id", "operation"),
    ("sendgrid.send", "sendgrid", "x-message-id", "message_id", "operation"),
    ("stripe.charge", "stripe", "id", "charge_id", "operation"),
    ("stripe.refund", "stripe", "id", "refund_id", "operation"),
    ("jira.create_issue", "jira", "key", "issue_key", "operation"),
    ("jira.create_issue", "jira", "id", "issue_id", "object"),
    ("servicenow.create_record", "servicenow", "result.sys_id", "sys_id", "operation"),
    ("servicenow.create_record", "servicenow", "sys_id", "sys_id", "operation"),
    ("kubernetes.apply", "kubernetes", "metadata.resourceVersion", "resource_version", "operation"),
    ("kubernetes.apply", "kubernetes", "metadata.uid", "resource_uid", "object"),
    ("aws.cloudtrail.event", "aws:cloudtrail", "eventID", "event_id", "operation"),
    ("github.create_pull_request", "github", "node_id", "node_id", "operation"),
    ("github.create_pull_request", "github", "number", "pull_request_number", "object"),
    ("postgres.commit", "postgresql", "commit_lsn", "commit_lsn", "operation"),
    ("postgres.commit", "postgresql", "pg_current_wal_lsn", "cluster_wal_position", "object"),
)


def _at_path(path: str) -> Column:
    """The text of a response at a path, null where there is none or only white space."""
    *parents, name = path.split(".")
    if "-" in name:
        headers = F.map_entries(F.from_json(F.get_json_object("response", ".".join(["$", *parents])), "map<string,string>"))
        value = F.get(F.filter(headers, lambda h: F.lower(h["key"]) == name), 0)["value"]
    else:
        value = F.get_json_object("response", f"$.{path}")
    return F.nullif(F.trim(value), F.lit(""))


def receipts(responses: DataFrame) -> DataFrame:
    """responses (operation, response JSON) with receipt (authority, kind, identifier, assurance): the first path that holds a value."""
    options = []
    for operation, authority, path, kind, assurance in RECEIPT_PATHS:
        value = _at_path(path)
        options.append(F.when((F.col("operation") == operation) & value.isNotNull(), F.struct(F.lit(authority).alias("authority"), F.lit(kind).alias("kind"), value.alias("identifier"), F.lit(assurance).alias("assurance"))))
    return responses.withColumn("receipt", F.coalesce(*options))


def adapted(trajectories: DataFrame) -> DataFrame:
    """Event rows of trajectories (trajectory_id, error, steps array<struct<role, content>>): a start and an end per tool step.

    Trajectories with an error are left out. A missing scanner answer stays missing.
    """
    steps = trajectories.where("error IS NULL").select("trajectory_id", F.posexplode("steps").alias("step", "s"))
    pair = F.array(F.struct(F.lit("tool_start").alias("event_type"), (F.col("step") * 2).cast("double").alias("ts")), F.struct(F.lit("tool_end").alias("event_type"), (F.col("step") * 2 + 1).cast("double").alias("ts")))
    return steps.select(F.col("trajectory_id").alias("session_id"), F.col("s.role").alias("tool_name"), F.inline(pair), F.lit(None).cast("boolean").alias("marked"))
