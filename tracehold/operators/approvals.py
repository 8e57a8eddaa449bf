"""Approvals that an issuer signed, good for one use: what each is worth, and which calls they cover where that is required."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tracehold.operators import chains
from tracehold.operators.bindings import CONTROL
from tracehold.operators.detect import small
from tracehold.operators.signatures import even, holds

SCHEME, ROLE = "approval/1", "approver"
#: What an approval is worth, from the weakest on.
TIERS = ("claimed", "bound", "authenticated", "single_use")
FIELDS = ("decision", "span_id", "tool_id", "arg_digest", "nonce", "granted_at", "expires_at")


@F.pandas_udf(StringType())
def message(decision: pd.Series, span_id: pd.Series, tool_id: pd.Series, arg_digest: pd.Series, nonce: pd.Series, granted_at: pd.Series, expires_at: pd.Series) -> pd.Series:
    """What an issuer signs: every field that a replay would rewrite, in a fixed order. Numbers are spelled as JSON spells them."""
    number = lambda x: "" if pd.isna(x) else repr(float(x))
    text = lambda x: x if isinstance(x, str) else ""
    rows = zip(decision, span_id, tool_id, arg_digest, nonce, granted_at, expires_at, strict=True)
    return pd.Series([chains.SEPARATOR.join((SCHEME, *map(text, r[:5]), number(r[5]), number(r[6]))) for r in rows], dtype=object)


def verified(approvals: DataFrame, keys: DataFrame) -> DataFrame:
    """approvals (FIELDS, key_id, sig) with verified.

    A signature counts only on an approval that expires, under a known key that may approve, is not revoked, and was
    valid when the approval was granted; then it is computed. A field with a control character would make what is signed
    ambiguous, so it is never verified. A bad signature is worth as much as none.
    """
    known = approvals.join(small(keys.select("key_id", "public", "roles", "not_before", "not_after", "revoked_at")), "key_id", "left")
    inside = F.coalesce((F.coalesce("not_before", F.lit(float("-inf"))) <= F.col("granted_at")) & (F.col("granted_at") <= F.coalesce("not_after", F.lit(float("inf")))), F.lit(True))
    clear = ~F.coalesce(F.concat_ws(" ", *FIELDS[:5]).rlike(CONTROL), F.lit(False))
    may = F.col("sig").isNotNull() & F.col("expires_at").isNotNull() & F.array_contains("roles", ROLE) & F.col("revoked_at").isNull() & inside & clear
    tried = known.withColumns({"_message": message(*FIELDS), "_tried": F.when(may, F.col("public"))})
    dealt = even(tried, "_tried", "_message", "sig")
    return dealt.withColumn("verified", F.coalesce(holds("_tried", "_message", "sig"), F.lit(False))).drop("_message", "_tried", "public", "roles", "not_before", "not_after", "revoked_at")


def spent(approvals: DataFrame, ledger: DataFrame) -> DataFrame:
    """verified() approvals (arrival) with unspent: whether a verified one is the first to use its nonce, in this run and in those of the ledger (nonce).

    Null without a nonce, and for what is not verified: that cannot use up another's nonce.
    """
    good = chains.spent_nonces(approvals.where("verified"), ledger).withColumn("unspent", F.when(F.col("use") != "no_nonce", F.col("use") == "first")).drop("use")
    return good.unionByName(approvals.where("NOT verified").withColumn("unspent", F.lit(None).cast("boolean")))


def next_ledger(approvals: DataFrame, ledger: DataFrame) -> DataFrame:
    """(nonce) of the ledger after a run: what it held and what verified approvals used."""
    return ledger.select("nonce").union(approvals.where("verified AND nonce IS NOT NULL").select("nonce")).distinct()


def tier() -> Column:
    """The tier of an approval, as a word of TIERS."""
    whole = F.col("span_id").isNotNull() & F.col("tool_id").isNotNull() & F.col("arg_digest").isNotNull()
    return F.when(F.col("verified") & F.coalesce("unspent", F.lit(False)), TIERS[3]).when(F.col("verified"), TIERS[2]).when(whole, TIERS[1]).otherwise(TIERS[0])


def assured() -> Column:
    """Whether an approval may cover a call where signed ones are required: verified, and not a second use of its nonce."""
    return F.col("verified") & F.coalesce("unspent", F.lit(True))


def judged(approvals: DataFrame, keys: DataFrame, ledger: DataFrame) -> DataFrame:
    """approvals (FIELDS, key_id, sig, arrival) with verified, unspent, tier and assured."""
    return spent(verified(approvals, keys), ledger).withColumns({"tier": tier(), "assured": assured()})
