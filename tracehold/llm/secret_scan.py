"""Secret scans: fixed patterns, and a battery of randomness tests for strings that no pattern knows.

Only SQL functions run here. A candidate is a run of letters, digits and `+/_-` of 20 characters or more that holds both
letters and digits and touches no pattern's span. Its encoding is inferred from the characters in it (hexadecimal,
base 32, letters and digits, the two alphabets of base 64, or both). Three tests ask whether it could be a uniform draw from that alphabet:

- chi-squared of the counts of characters, with the Wilson-Hilferty normal approximation;
- Wald-Wolfowitz runs above and below the middle of the alphabet;
- serial correlation of neighbouring characters.

Fisher's method combines the three. Text is told from random strings by the Benjamini-Hochberg procedure within each
encoding and length band, over a histogram of all candidates' p-values: a candidate is cleared as ordinary text when
it is among the discoveries at rate q, and reported as `random` when uniformity stands.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracehold.llm.storage import written

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: The same spans as `AKIA[A-Z0-9]+` and `[0-9a-f]+` after short matches are dropped: each run is matched as a whole.
ACCESS, HEX = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
MIN_VALUE = 6
KINDS = ("assign", "access", "hex", "random")
SPAN = "array<struct<start:int,kind:int,end:int>>"
#: Name, characters in order, pattern. The first that fits is inferred.
ENCODINGS = (
    ("hex", "0123456789abcdef", "^[0-9a-f]+$"),
    ("HEX", "0123456789ABCDEF", "^[0-9A-F]+$"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "^[A-Z2-7]+$"),
    ("base62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "^[0-9A-Za-z]+$"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "^[0-9A-Za-z+/]+$"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", "^[0-9A-Za-z_-]+$"),
    ("mixed", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_", "^.+$"),
)
#: Lower ends of the length bands, false-discovery rate, and bins of the p-value histogram (tenths of -ln p).
BANDS, RATE, BINS = (20, 32, 48, 80, 160), 0.05, 400
#: Matches whose places are summed together.
BLOCK = 256


def _blocks(rows: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(rows) - 1, F.lit(0)) / BLOCK).cast("int")), lambda b: F.slice(rows, b * BLOCK + 1, F.lit(BLOCK)))


def _matches(text: Column, pattern: str, keep: int | None = None) -> Column:
    """Leftmost non-overlapping matches as structs (start, end, found, value), by code points.

    Ends are sums of what was skipped and found before, taken block by block so that work is linear in the matches.
    """
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if keep else found
    nothing = F.array().cast("array<struct<start:int,end:int,found:string,value:string>>")

    def located(rows: Column) -> Column:
        long = lambda x: F.length(x["skipped"]) + F.length(x["found"])
        sums = F.transform(_blocks(rows), lambda b: F.struct(b.alias("rows"), F.aggregate(b, F.lit(0), lambda acc, x: acc + long(x)).alias("size")))
        empty = F.array().cast("array<struct<rows:array<struct<skipped:string,found:string,value:string>>,at:int>>")
        begun = F.aggregate(
            sums, F.struct(F.lit(0).alias("at"), empty.alias("out")),
            lambda acc, b: F.struct((acc["at"] + b["size"]).alias("at"), F.concat(acc["out"], F.array(F.struct(b["rows"].alias("rows"), acc["at"].alias("at")))).alias("out")),
        )["out"]

        def walked(block: Column) -> Column:
            return F.aggregate(
                block["rows"],
                F.struct(block["at"].alias("at"), nothing.alias("out")),
                lambda acc, x: F.struct(
                    (acc["at"] + long(x)).alias("at"),
                    F.concat(acc["out"], F.array(F.struct((acc["at"] + F.length(x["skipped"])).alias("start"), (acc["at"] + long(x)).alias("end"), x["found"].alias("found"), x["value"].alias("value")))).alias("out"),
                ),
            )["out"]

        return F.flatten(F.transform(begun, walked))

    rows = F.slice(F.arrays_zip(pieces.alias("skipped"), found.alias("found"), value.alias("value")), F.lit(1), F.size(found))
    walked = _let(rows, located)
    kept = F.filter(walked, lambda x: F.length(x["value"]) >= keep) if keep else walked
    return F.when(text.rlike(pattern), kept).otherwise(nothing)


def _as_spans(matches: Column, kind: int) -> Column:
    return F.transform(matches, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end"))).cast(SPAN)


def _named(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.sort_array(spans), lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")


def _let(value: Column, body) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _upper_normal(z: Column) -> Column:
    """P(Z > z) by a rational approximation good to 1e-7; z is a plain reference."""

    def tail(t: Column) -> Column:
        poly = reduce(lambda acc, c: (acc + F.lit(c)) * t, (1.330274429, -1.821255978, 1.781477937, -0.356563782, 0.319381530), F.lit(0.0))
        upper = F.exp(-z * z / 2) * F.lit(0.3989422804014327) * poly
        return F.greatest(F.when(z >= 0, upper).otherwise(1 - upper), F.lit(1e-18))

    return _let(F.lit(1.0) / (F.lit(1.0) + F.lit(0.2316419) * F.abs(z)), tail)


def _tested(token: Column) -> Column:
    """Struct (stratum, surprise): the inferred encoding and length band, and -ln of Fisher's combined p-value."""
    bare = F.rtrim(token, F.lit("="))
    which = reduce(lambda rest, i: F.when(bare.rlike(ENCODINGS[i][2]), F.lit(i)).otherwise(rest), reversed(range(len(ENCODINGS))), F.lit(len(ENCODINGS) - 1))
    alphabet = F.element_at(F.array(*(F.lit(a) for _, a, _ in ENCODINGS)), which + 1)

    def statistics(s: Column) -> Column:
        k, n = F.length(s["alphabet"]).cast("double"), F.length(s["bare"]).cast("double")
        # places in the alphabet, one per character, and the squared counts of its characters
        marks = F.transform(F.slice(F.split(s["bare"], ""), F.lit(1), F.length(s["bare"])), lambda c: (F.instr(s["alphabet"], c) - 1).cast("double"))
        counts = F.transform(F.slice(F.split(s["alphabet"], ""), F.lit(1), F.length(s["alphabet"])), lambda c: n - F.length(F.replace(s["bare"], c, F.lit(""))))
        squares = F.aggregate(counts, F.lit(0.0), lambda acc, v: acc + v * v)
        return _let(F.struct(s["which"].alias("which"), k.alias("k"), n.alias("n"), marks.alias("x"), squares.alias("squares")), _scores)

    return _let(F.struct(bare.alias("bare"), which.alias("which"), alphabet.alias("alphabet")), statistics)


def _scores(s: Column) -> Column:
    x, k, n = s["x"], s["k"], s["n"]
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v)
    rest = F.greatest(F.size(x) - 1, F.lit(0))
    pairs = F.slice(F.arrays_zip(x.alias("a"), F.concat(F.slice(x, F.lit(2), rest), F.array(F.lit(0.0))).alias("b")), F.lit(1), rest)
    high = F.size(F.filter(x, lambda v: v >= k / 2)).cast("double")
    counted = F.struct((s["squares"] * k / n - n).alias("chi"), pairs.alias("pairs"), high.alias("high"), (total(x) / n).alias("mean"))

    def statistics(c: Column) -> Column:
        runs = 1 + F.size(F.filter(c["pairs"], lambda p: (p["a"] >= k / 2) != (p["b"] >= k / 2))).cast("double")
        variance = total(F.transform(x, lambda v: (v - c["mean"]) * (v - c["mean"])))
        together = total(F.transform(c["pairs"], lambda p: (p["a"] - c["mean"]) * (p["b"] - c["mean"])))
        return F.struct(c["chi"].alias("chi"), c["high"].alias("high"), (2 * c["high"] * (n - c["high"]) / n + 1).alias("expected"), runs.alias("runs"), variance.alias("variance"), together.alias("together"))

    def deviations(c: Column) -> Column:
        df = k - 1
        z_chi = (F.pow(F.greatest(c["chi"], F.lit(1e-9)) / df, F.lit(1 / 3)) - (1 - F.lit(2.0) / (9 * df))) / F.sqrt(F.lit(2.0) / (9 * df))
        spread = F.sqrt(F.greatest((c["expected"] - 1) * (c["expected"] - 2) / F.greatest(n - 1, F.lit(1.0)), F.lit(1e-9)))
        z_runs = F.when((c["high"] == 0) | (c["high"] == n), F.sqrt(n)).otherwise(F.abs(c["runs"] - c["expected"]) / spread)
        serial = F.when(c["variance"] > 0, c["together"] / c["variance"]).otherwise(F.lit(1.0))
        return F.struct(z_chi.alias("chi"), z_runs.alias("runs"), (F.abs(serial + 1 / n) * F.sqrt(n)).alias("serial"))

    def fisher(z: Column) -> Column:
        one_sided, two_sided = _upper_normal(z["chi"]), [F.least(F.lit(1.0), 2 * _upper_normal(z[c])) for c in ("runs", "serial")]
        return -(F.log(one_sided) + F.log(two_sided[0]) + F.log(two_sided[1]))

    band = sum((F.when(n >= b, 1).otherwise(0) for b in BANDS[1:]), F.lit(0))
    half = _let(_let(_let(counted, statistics), deviations), fisher)
    surprise = _let(half, lambda h: F.greatest(h - F.log(1 + h + h * h / 2), F.lit(0.0)))
    return F.struct((s["which"] * len(BANDS) + band).cast("int").alias("stratum"), surprise.alias("surprise"))


def _candidates(text: Column, base: Column) -> Column:
    """Tested structs (start, end, stratum, surprise) of candidates that touch no base span."""
    found = F.filter(_matches(text, CANDIDATE), lambda x: x["found"].rlike("[0-9]") & x["found"].rlike("[A-Za-z]"))
    free = F.filter(found, lambda x: ~F.exists(base, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    return F.transform(free, lambda x: _let(_tested(x["found"]), lambda t: F.struct(x["start"].alias("start"), x["end"].alias("end"), t["stratum"].alias("stratum"), t["surprise"].alias("surprise"))))


def _with_base(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "*",
        _as_spans(_matches(text, ASSIGN, MIN_VALUE), 0).alias("_assign"),
        _as_spans(_matches(text, ACCESS), 1).alias("_access"),
        _as_spans(_matches(text, HEX), 2).alias("_hex"),
    )


def cleared_from(tested: DataFrame, rate: float = RATE) -> dict[int, float]:
    """For each stratum the least surprise of the Benjamini-Hochberg discoveries (ordinary text), from (stratum, surprise).

    The p-values meet in a histogram of at most len(ENCODINGS) * len(BANDS) * BINS rows, so only that table is gathered.
    """
    bins = tested.groupBy("stratum", F.least(F.floor(F.col("surprise") * 10), F.lit(BINS - 1)).cast("int").alias("bin")).count().collect()
    found: dict[int, float] = {}
    for stratum in {r["stratum"] for r in bins}:
        counts = {r["bin"]: r["count"] for r in bins if r["stratum"] == stratum}
        m, above = sum(counts.values()), 0
        for b in sorted(counts, reverse=True):
            above += counts[b]
            if pow(2.718281828459045, -b / 10) <= rate * above / m:
                found[stratum] = b / 10
    return found


def scan(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """docs with n_assign, n_access, n_hex, base (spans of the patterns), spans (all spans) and the two digests' texts.

    Added columns: n_assign, n_access, n_hex, n_random long; base_spans, all_spans array<struct<start,kind,end>>;
    base_text, spans string `kind:start:end,...` by start, then kind. Offsets count code points, ends are exclusive.
    Null and empty texts have no spans. Repeated rows are scanned alike and stay; an empty table stays empty. Columns
    of docs named like the added ones, or with a leading underscore, are replaced.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = F.concat("_assign", "_access", "_hex")
    added = ("n_assign", "n_access", "n_hex", "n_random", "base_spans", "all_spans", "base_text", "spans")
    # texts are searched once: what is found is written beside them
    tested = written(_with_base(docs.drop(*added, "_assign", "_access", "_hex", "_tested")).withColumn("_tested", _candidates(text, base)), "secrets-tested")
    limits = cleared_from(tested.select(F.explode("_tested").alias("t")).select("t.stratum", "t.surprise"), rate)
    limit = F.create_map(*(F.lit(v) for pair in limits.items() for v in pair)) if limits else F.create_map(F.lit(-1), F.lit(0.0))
    random = F.filter("_tested", lambda x: x["surprise"] < F.coalesce(limit[x["stratum"]], F.lit(float("inf"))))
    return tested.withColumns({
        "n_assign": F.size("_assign").cast("long"), "n_access": F.size("_access").cast("long"), "n_hex": F.size("_hex").cast("long"), "n_random": F.size(random).cast("long"),
        "base_spans": base, "all_spans": F.concat(base, _as_spans(random, 3)),
    }).drop("_assign", "_access", "_hex", "_tested").withColumns({"base_text": _named(F.col("base_spans")), "spans": _named(F.col("all_spans"))})


def redact(scanned: DataFrame) -> DataFrame:
    """The documents of scan(), each run of overlapping spans in text replaced by `[kind]` of the first of them."""
    names = F.array(*map(F.lit, KINDS))
    text = F.coalesce(F.col("text"), F.lit(""))
    nothing = F.array().cast("array<string>")
    state = lambda at, out: F.struct(at.cast("int").alias("at"), out.alias("out"))

    def block(acc: Column, spans: Column) -> Column:
        """The texts up to the end of some spans, cut from the part of the text that they reach over."""
        begin, end = acc["at"], F.greatest(acc["at"], F.array_max(F.transform(spans, lambda x: x["end"])))

        def cut(own: Column) -> Column:
            return F.aggregate(
                spans,
                state(begin, nothing),
                lambda a, x: F.when(x["start"] < a["at"], state(F.greatest(a["at"], x["end"]), a["out"])).otherwise(
                    state(x["end"], F.concat(a["out"], F.array(F.substr(own, a["at"] - begin + 1, x["start"] - a["at"]), F.concat(F.lit("["), F.element_at(names, x["kind"] + 1), F.lit("]")))))
                ),
                lambda a: state(a["at"], F.concat(acc["out"], F.array(F.array_join(a["out"], "")))),
            )

        return _let(F.substr(text, begin + 1, end - begin), cut)

    parts = F.aggregate(_blocks(F.sort_array("all_spans")), state(F.lit(0), nothing), block, lambda acc: F.concat(acc["out"], F.array(F.substr(text, acc["at"] + 1, F.length(text)))))
    return scanned.withColumn("text", F.when(F.size("all_spans") > 0, F.array_join(parts, "")).otherwise(F.col("text")))
