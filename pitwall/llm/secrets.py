"""Secret scans with multipart credential linking, in DataFrame functions alone.

Base kinds are found wherever they stand: ``assign`` (a keyword, a sign and a value
of 12 characters or more), ``access`` (an access identifier) and ``hex`` (a long run
of lower-case hex digits), leftmost and without overlap within a kind. Two kinds are
weak and mean nothing alone: ``secret`` (24 or more key characters with a letter
and a digit, not touching a base span) and ``endpoint`` (a URL or an IPv4
address). A document's spans are scopes: an interval join by start order gives
every weak candidate the nearest parts before and after it. A ``secret`` is
reported if an access identifier lies within ``scope`` code points of it, an
``endpoint`` if an access identifier or an assignment does.

Spans are in code points, end exclusive. A pattern with ``\\G`` and a lazy prefix
yields each match together with the text before it, whose lengths add up to the
positions; texts without a pattern's fixed part are not searched for it.

Null and empty texts have no spans. Rows with one doc_id twice, or equal rows, are
scanned each on its own. Empty tables give no rows. ``find_secrets`` reads doc_id
and text; ``redact`` carries all other columns along, whatever their names, and
renews n_chars if there is one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pitwall.llm.common import stored

# kind: (pattern, group of the part that must be long enough, its least length), in the order of the report.
BASE = {
    "assign": (r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"""
               r"""|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 3, 12),
    "access": (r"AKIA[A-Z0-9]+", 2, 18),
    "hex": (r"[0-9a-f]{16,}", 2, 16),  # runs are maximal, so shorter ones need no dropping
}
WEAK = {
    "secret": (r"[A-Za-z0-9+/_=-]{24,}", 2, 24),
    "endpoint": (r"""[A-Za-z][A-Za-z0-9+.-]{0,15}://[^\x00-\x20"'<>]+|(?:[0-9]{1,3}\.){3}[0-9]{1,3}""", 2, 7),
}
KINDS = [*BASE, *WEAK]
KEYWORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
_FOUND = "array<struct<kind:int,before:int,whole:int,part:string>>"


def _possible(text: Column) -> dict[str, Column]:
    """Cheap conditions that every text with a span of a base kind meets."""
    low = F.lower(text)
    assign = F.lit(False)
    for k in KEYWORDS:
        assign = assign | low.contains(k)
    return {"assign": assign, "access": text.contains("AKIA"), "hex": text.rlike("[0-9a-f]{16}")}


def _matches(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """All matches of a kind with the length of the text before each."""
    rule = F.lit(rf"\G((?s:.*?))({pattern})")
    parts = F.arrays_zip(F.regexp_extract_all(text, rule, F.lit(1)).alias("b"),
                         F.regexp_extract_all(text, rule, F.lit(2)).alias("w"),
                         F.regexp_extract_all(text, rule, F.lit(group)).alias("p"))
    return F.transform(parts, lambda x: F.struct(
        F.lit(KINDS.index(kind)).alias("kind"), F.length(x["b"]).alias("before"), F.length(x["w"]).alias("whole"),
        F.when(F.length(x["p"]) >= least, x["p"]).alias("part"))).cast(_FOUND)


def _found(text: Column) -> Column:
    """Matches of every kind in one array; weak kinds only beside a possible anchor."""
    may, none = _possible(text), F.array().cast(_FOUND)
    anchored = may["assign"] | may["access"]
    arrays = [F.when(may[k], _matches(text, k, *rule)).otherwise(none) for k, rule in BASE.items()]
    arrays += [F.when(anchored, _matches(text, k, *rule)).otherwise(none) for k, rule in WEAK.items()]
    return F.concat(*arrays)


def _spans(found: DataFrame, scope: int) -> DataFrame:
    """``row``, and its reported spans as a sorted array of (start, kind, end)."""
    each = found.where(F.size("found") > 0).select("row", F.posexplode("found").alias("at", "m")).select("row", "at", "m.*")
    order = W.partitionBy("row", "kind").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    end = F.sum(F.col("before") + F.col("whole")).over(order)
    each = each.select("row", "kind", "part", F.col("whole").alias("n"), end.alias("end"))
    each = each.where("part IS NOT NULL").select("row", "kind", "part", (F.col("end") - F.col("n")).alias("start"), "end")
    secret, endpoint = KINDS.index("secret"), KINDS.index("endpoint")
    each = each.where((F.col("kind") != secret) | (F.col("part").rlike("[0-9]") & F.col("part").rlike("[A-Za-z]")))

    before = W.partitionBy("row").orderBy("start", "kind", "end").rowsBetween(W.unboundedPreceding, 0)
    after = W.partitionBy("row").orderBy("start", "kind", "end").rowsBetween(0, W.unboundedFollowing)
    access, base = F.col("kind") == KINDS.index("access"), F.col("kind") < len(BASE)
    anchor = F.col("kind") <= KINDS.index("access")

    def near(part: Column, distance: int) -> Column:
        last, first = F.max(F.when(part, F.col("end"))).over(before), F.min(F.when(part, F.col("start"))).over(after)
        return F.coalesce(F.col("start") - last <= distance, F.lit(False)) | F.coalesce(
            first - F.col("end") <= distance, F.lit(False))

    each = each.withColumns({"access": near(access, scope), "anchor": near(anchor, scope), "touching": near(base, -1)})
    keep = base | ((F.col("kind") == secret) & F.col("access") & ~F.col("touching")) | (
        (F.col("kind") == endpoint) & F.col("anchor"))
    return each.where(keep).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))


def _text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, scope: int = 200) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base (base spans as text) and spans (all reported spans as text)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = stored(docs.select(F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("row"),
                               _found(text).alias("found")), "found")
    out = found.select("doc_id", "row").join(_spans(found, scope), "row", "left")
    spans = F.coalesce("spans", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>"))
    base = F.filter(spans, lambda s: s["kind"] < len(BASE))

    def of(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")

    count = [of(name).alias(f"n_{name}") for name in BASE]
    return out.select("doc_id", *count, _text(base).alias("base"), _text(spans).alias("spans"))


def redact(docs: DataFrame, scope: int = 200, mark: str = "[redacted]") -> DataFrame:
    """The same rows with every reported span of the text replaced by ``mark``.

    Only rows that may have a span are stored and joined; the others pass as they are.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    may = _possible(text)
    possible = may["assign"] | may["access"] | may["hex"]
    some = stored(docs.where(possible).select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
                                              F.monotonically_increasing_id().alias("row")), "secrets")
    found = some.select("row", _found(F.col("doc.text")).alias("found"))
    some = some.join(_spans(found, scope), "row", "left")
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("to"))
    text = F.col("doc.text")

    def step(s: Column, x: Column) -> Column:  # an overlapping span lengthens the mark before it
        gap = F.substring(text, s["to"].cast("int") + 1, F.greatest(F.lit(0), x["start"] - s["to"]).cast("int"))
        fresh = (x["start"] >= s["to"]) & ((s["out"] == "") | (x["start"] > s["to"]) | (x["start"] == 0))
        return F.struct(F.when(fresh, F.concat(s["out"], gap, F.lit(mark))).otherwise(s["out"]).alias("out"),
                        F.greatest(s["to"], x["end"]).alias("to"))

    done = F.aggregate("spans", start, step, lambda s: F.concat(s["out"], F.substring(text, s["to"].cast("int") + 1, 1 << 30)))
    clean = F.when(F.col("spans").isNull(), text).otherwise(done)
    columns = {c: F.col("doc").getField(c).alias(c) for c in docs.columns}
    columns["text"] = clean.alias("text")
    if "n_chars" in columns:
        changed = F.col("spans").isNotNull()
        kind = docs.schema["n_chars"].dataType
        columns["n_chars"] = F.when(changed, F.length(clean).cast(kind)).otherwise(F.col("doc.n_chars")).alias("n_chars")
    return docs.where(~possible).unionByName(some.select(*columns.values()))
