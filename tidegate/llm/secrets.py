"""Secret scans with multipart credential linking (operator 3), in DataFrame functions only.

Base spans, leftmost and without overlap for each kind, offsets in code points, end exclusive:

* ``assign``: a key word, ``:`` or ``=``, and a value of 12 characters or more;
* ``access``: an access key id of 18 characters or more;
* ``hex``: a run of 16 hex digits or more.

Weak candidates are access identifiers (short key ids, ``client_id = ...``), secrets (tokens of 20
characters or more that mix upper case, lower case and digits) and endpoints (URLs). They are
reported, as ``link_id``, ``link_secret`` and ``link_endpoint``, only where complementary parts lie
within ``SCOPE`` code points before or after them, without overlap: an identifier beside a secret, a
secret beside an identifier, an endpoint beside both. An identifier's own value is thus no secret
beside it. Base spans count as parts too, and always stay; a weak one inside a base span is not
reported again. The interval join is a sweep over the starts and ends of a text's parts: each start
has the nearest end of every role at or before it, each end the nearest start at or after it, so parts
in one scope never pair up one by one, and the work grows with the parts of a text.

Null text counts as empty: no spans. A very long text is scanned whole, and its spans are listed
whole. Spans that start together come in the order of ``KINDS``. Repeated rows are scanned alike; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegate.llm.common import materialise

SCOPE = 160
MASK = "[REDACTED]"
#: Fixed patterns and shortest lengths of the base kinds, in the order in which equal starts are listed.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}+"
HEX = r"[0-9a-f]{16,}+"
ASSIGN_VALUE = 12
#: Weak candidates.
IDENTIFIER = r"""AKIA[A-Z0-9]++|(?<![A-Za-z0-9])(?i:client_?id|access_?key_?id|account_?id|user_?name|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}+"""
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
ENDPOINT = r"""(?<![A-Za-z0-9])(?i:https?|ftp|ssh|jdbc|postgres|postgresql|mysql|mongodb|redis|amqp)://[^\x20\x09-\x0D"'<>]++"""
KINDS = ["assign", "access", "hex", "link_id", "link_secret", "link_endpoint"]
BASE = KINDS[:3]

_PARTS = "array<struct<kind:int,at:int,gap:int,size:int,good:boolean>>"


def _parts(text: Column, pattern: str, kind: int, good: Column | None = None) -> Column:
    """The matches of a pattern in order: code points since the match before, length, whether it counts."""
    gaps = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    good = F.transform(found, lambda m: F.lit(True)) if good is None else good
    zipped = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("g"), found.alias("m"), good.alias("ok"))
    rows = F.transform(zipped, lambda z, i: F.struct(F.lit(kind).alias("kind"), i.alias("at"), F.length(z["g"]).alias("gap"), F.length(z["m"]).alias("size"), z["ok"].alias("good")))
    return F.when(F.size(found) > 0, rows).otherwise(F.array().cast(_PARTS))


def _mixed(token: Column) -> Column:
    return token.rlike("[A-Z]") & token.rlike("[a-z]") & token.rlike("[0-9]")


def _spans(rows: DataFrame) -> DataFrame:
    """row, kind, start, end of every span, and a row of nulls for each row without: ``rows`` has row, text."""
    text = F.col("text")
    values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    none = F.array().cast(_PARTS)
    parts = rows.select(
        "row",
        "text",
        _parts(text, ASSIGN, 0, F.transform(values, lambda v: F.length(v) >= ASSIGN_VALUE)).alias("assign"),
        F.when(text.contains("AKIA"), _parts(text, ACCESS, 1)).otherwise(none).alias("access"),
        F.when(text.rlike(HEX), _parts(text, HEX, 2)).otherwise(none).alias("hex"),
        F.when(text.rlike(IDENTIFIER), _parts(text, IDENTIFIER, 3)).otherwise(none).alias("ids"),
    )
    tokens = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    some = F.size("ids") > 0  # nothing weak is reported without an identifier
    parts = parts.select(
        "row",
        F.concat(
            "assign", "access", "hex", "ids",
            F.when(some & text.rlike(TOKEN), _parts(text, TOKEN, 4, F.transform(tokens, _mixed))).otherwise(none),
            F.when(some & text.contains("://"), _parts(text, ENDPOINT, 5)).otherwise(none),
        ).alias("parts"),
    )
    # One exchange, by row; the windows and the sums after it keep to it.
    each = parts.select("row", F.explode_outer("parts").alias("p")).select("row", "p.*").repartition("row")
    order = Window.partitionBy("row", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = each.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(order)).withColumn("start", F.col("end") - F.col("size"))
    # What is too short keeps its row, so a text without spans still has one.
    each = each.select("row", F.when(F.col("good"), F.col("kind")).alias("kind"), "start", "end")

    # Starts (1) and ends (0) on one line; at one place ends come first, as parts may touch.
    ends = each.withColumn("side", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("place", F.when(F.col("side") == 0, F.col("end")).otherwise(F.col("start")))
    upward = Window.partitionBy("row").orderBy("place", "side", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    downward = Window.partitionBy("row").orderBy(F.desc("place"), F.desc("side")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Base spans are identifiers or secrets beside the weak ones.
    roles = {"id": F.col("kind").isin(1, 3), "secret": F.col("kind").isin(0, 2, 4)}
    sides = {n: F.max(F.when(is_role & (F.col("side") == 0), F.col("place"))).over(upward) for n, is_role in roles.items()}
    reach = F.max(F.when((F.col("side") == 1) & (F.col("kind") < len(BASE)), F.col("end"))).over(upward)
    ends = ends.select("*", reach.alias("reach"), *(d.alias(f"{n}_before") for n, d in sides.items()))
    sides = {n: F.min(F.when(is_role & (F.col("side") == 1), F.col("place"))).over(downward) for n, is_role in roles.items()}
    ends = ends.select("*", *(d.alias(f"{n}_after") for n, d in sides.items()))
    near = {n: F.when(F.col("side") == 1, F.col("place") - F.col(f"{n}_before") <= SCOPE).otherwise(F.col(f"{n}_after") - F.col("place") <= SCOPE) for n in roles}
    # A weak part inside a base span says nothing new.
    inside = F.max((F.col("side") == 1) & (F.col("kind") >= len(BASE)) & F.coalesce(F.col("reach") >= F.col("end"), F.lit(False)))
    spans = ends.groupBy("row", "kind", "start", "end").agg(inside.alias("inside"), *(F.coalesce(F.max(x), F.lit(False)).alias(f"near_{n}") for n, x in near.items()))
    linked = (
        F.when(F.col("kind") == 3, F.col("near_secret"))
        .when(F.col("kind") == 4, F.col("near_id"))
        .when(F.col("kind") == 5, F.col("near_id") & F.col("near_secret"))
        .otherwise(True)
    ) & ~F.coalesce("inside", F.lit(False))
    return spans.select("row", F.when(linked, F.col("kind")).alias("kind"), "start", "end")


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _number_of(spans: str, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def secret_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked: one row for every row of ``docs``."""
    numbered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("row", F.monotonically_increasing_id())
    # The id rides along with the number of its row, so nothing is joined back.
    spans = _spans(numbered.select(F.struct("row", "doc_id").alias("row"), "text"))
    span = F.struct("start", "kind", "end")
    grouped = spans.groupBy("row").agg(F.array_sort(F.collect_list(F.when(F.col("kind").isNotNull(), span))).alias("all"))
    base = F.filter("all", lambda s: s["kind"] < len(BASE))
    return grouped.select(
        F.col("row.doc_id").alias("doc_id"),
        *(_number_of("all", k).alias(f"n_{name}") for k, name in enumerate(BASE)),
        F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"),
        _listed(F.col("all")).alias("spans"),
        F.size(F.filter("all", lambda s: s["kind"] >= len(BASE))).cast("long").alias("n_linked"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """All rows of ``docs`` with all their columns; spans in ``text`` are masked, and ``n_chars``, if there, follows.

    Overlapping spans become one mask. Rows without a hit pass by unshuffled.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    hit = text.rlike(ASSIGN) | text.rlike(ACCESS) | text.rlike(HEX) | text.rlike(IDENTIFIER)
    numbered = materialise(docs.filter(hit).select("*", F.monotonically_increasing_id().alias("__tg_row")), "secrets-hits")
    spans = _spans(numbered.select(F.col("__tg_row").alias("row"), F.col("text"))).filter("kind IS NOT NULL")
    # Runs of overlapping spans: a run starts where no span before reaches.
    order = Window.partitionBy("row").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("run", F.sum(F.when(F.col("start") < reach, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = spans.groupBy("row", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    runs = runs.groupBy(F.col("row").alias("__tg_span_row")).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("__tg_spans"))
    rows = numbered.join(runs, F.col("__tg_row") == F.col("__tg_span_row"), "left")
    clean = F.transform(
        "__tg_spans",
        lambda s, i: F.concat(F.substring("text", F.when(i == 0, 0).otherwise(F.element_at("__tg_spans", F.greatest(i, F.lit(1)))["end"]).cast("int") + 1, (s["start"] - F.when(i == 0, 0).otherwise(F.element_at("__tg_spans", F.greatest(i, F.lit(1)))["end"])).cast("int")), F.lit(MASK)),
    )
    tail = F.substring("text", (F.element_at("__tg_spans", -1)["end"] + 1).cast("int"), F.length("text"))
    rows = rows.withColumn("text", F.when(F.size("__tg_spans") > 0, F.concat(F.array_join(clean, ""), tail)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        rows = rows.withColumn("n_chars", F.when(F.size("__tg_spans") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return docs.filter(~hit).unionByName(rows.select(*docs.columns))
