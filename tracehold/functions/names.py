"""Tool names: their class by keywords, and their word tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keywords that say what a tool does. Those with an underscore match within the joined tokens.
EGRESS = ("http", "https", "post", "send", "webhook", "upload", "publish", "email", "message", "notify", "sync", "export", "transfer", "exfiltrate")
STATE_CHANGE = ("delete", "drop", "truncate", "remove", "destroy", "send_email", "send_message", "publish", "post", "transfer", "pay", "charge", "deploy", "overwrite", "format", "wipe")
READ_ONLY = ("read", "get", "fetch", "list", "search", "query", "draft", "preview", "analyze", "summarize")


def tokens(name: Column) -> Column:
    return F.filter(F.split(F.lower(name), "[^a-z0-9]+"), lambda t: t != "")


def tool_class(name: Column) -> Column:
    """egress, state_change, read_only or unknown, in that order of precedence; unknown for a null name."""
    own = tokens(name)

    def hit(keywords: tuple[str, ...]) -> Column:
        whole = F.arrays_overlap(own, F.array(*(F.lit(k) for k in keywords if "_" not in k)))
        for k in keywords:
            if "_" in k:
                whole = whole | F.array_join(own, "_").contains(k)
        return F.coalesce(whole, F.lit(False))

    return F.when(hit(EGRESS), "egress").when(hit(STATE_CHANGE), "state_change").when(hit(READ_ONLY), "read_only").otherwise("unknown")


def consequential(cls: Column) -> Column:
    return cls.isin("egress", "state_change")
