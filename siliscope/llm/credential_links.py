"""Secrets in review comments, found with column functions alone.

Certain finds are assignments of passwords and tokens, access key ids and long hexadecimal runs. Weak candidates - user or
client identifiers, long mixed runs, addresses of endpoints - mean little by themselves. They are linked by an interval join
within their scope, the comment: an identifier is reported when a secret starts at most ``window`` code points away, a mixed run
when an access identifier does, an endpoint when both do.

For the join the parts are laid into bins as wide as the window. Of a kind in a bin only the first and the last start matter to
other bins, so each scope, kind and bin becomes one row before the shuffle and a candidate meets three bins per kind;
pairs within a scope are never listed. Only comments with a candidate and something to link it to are joined at all, and texts
are not shuffled except those.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siliscope.llm.common import text_of
from siliscope.sources.staging import stage


def either_case(names: str) -> str:
    """A pattern that takes ASCII letters in either case, alike in every regular-expression dialect."""
    return "".join(f"[{c}{c.upper()}]" if c.isascii() and c.islower() else c for c in names)


KEYWORDS = either_case("(password|passwd|secret|token|api_?key)")
ASSIGN = KEYWORDS + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # a run of upper-case letters and digits after AKIA, 20 characters or more in all
HEX = r"[0-9a-f]{24,}"
IDENTIFIER = either_case("(user|client|account|access|key)") + "[_-]?" + either_case("(id|name)") + \
    r"""["']?\x20*[:=]\x20*["']?[A-Za-z0-9@_.-]{3,}"""
MIXED = r"[A-Za-z0-9+/]{32,}"
ENDPOINT = r"""https?://[^\x00-\x20"'<>]+"""
MIN_VALUE = 6
#: kinds in the order in which spans that start together are listed
KINDS = ("assign", "access", "hex", "identifier", "mixed", "endpoint")
#: what a part may complete: 1 names who, 2 proves it, 3 says where
ROLE = {"access": 1, "identifier": 1, "assign": 2, "hex": 2, "mixed": 2, "endpoint": 3}
SPAN = "array<struct<start:int,stop:int,kind:int>>"


def _spans(text: Column, pattern: str, kind: str, keep=None) -> Column:
    """Start and end in code points of every leftmost, non-overlapping match that ``keep`` accepts."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    number = F.lit(KINDS.index(kind))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(state: Column, pair: Column) -> Column:
        hit, gap = pair["hits"], pair["gaps"]
        start = state["at"] + F.length(gap)
        stop = start + F.length(hit)
        fit = keep(hit) if keep else F.lit(True)
        span = F.array(F.struct(start.alias("start"), stop.alias("stop"), number.alias("kind")))
        return F.struct(stop.alias("at"), F.when(fit, F.concat(state["out"], span)).otherwise(state["out"]).alias("out"))

    pairs = F.arrays_zip(hits.alias("hits"), F.slice(gaps, F.lit(1), F.size(hits)).alias("gaps"))
    return F.when(text.rlike(pattern), F.aggregate(pairs, zero, step, lambda s: s["out"])).otherwise(F.array().cast(SPAN))


def base_spans(text: Column) -> Column:
    """The certain finds of a text, by start and then kind."""
    signs = F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))
    none = F.array().cast(SPAN)
    assign = F.when(signs, _spans(text, ASSIGN, "assign", lambda hit: F.length(F.regexp_extract(hit, ASSIGN, 2)) >= MIN_VALUE)).otherwise(none)
    access = F.when(F.contains(text, F.lit("AKIA")), _spans(text, ACCESS, "access")).otherwise(none)
    return F.array_sort(F.concat(assign, access, _spans(text, HEX, "hex")), _by_start)


def _by_start(a: Column, b: Column) -> Column:
    first = F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1)
    return first.when(a["kind"] < b["kind"], -1).when(a["kind"] > b["kind"], 1).otherwise(0)


def weak_spans(text: Column, base: Column) -> Column:
    """Candidates that do not overlap a certain find."""
    none = F.array().cast(SPAN)
    signs = F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))
    mixed = lambda hit: hit.rlike("[0-9]") & hit.rlike("[A-Z]") & hit.rlike("[a-z]")
    found = F.concat(F.when(signs, _spans(text, IDENTIFIER, "identifier")).otherwise(none), _spans(text, MIXED, "mixed", mixed),
                     F.when(F.contains(text, F.lit("http")), _spans(text, ENDPOINT, "endpoint")).otherwise(none))
    return F.filter(found, lambda w: ~F.exists(base, lambda b: (b["start"] < w["stop"]) & (w["start"] < b["stop"])))


def _roles(spans: Column) -> Column:
    kind_role = F.array(*[F.lit(ROLE[k]) for k in KINDS])
    return F.array_distinct(F.transform(spans, lambda s: F.get(kind_role, s["kind"])))


def link(parts: DataFrame, window: int, scope: list[str]) -> DataFrame:
    """The weak parts that complementary parts of their scope lie near to.

    ``parts`` has the scope's columns, start, stop, kind, role and weak. Distances are between starts.
    """
    near = parts.groupBy(*scope, F.col("role").alias("other"), F.floor(F.col("start") / window).cast("int").alias("bin")).agg(
        F.min("start").alias("first"), F.max("start").alias("last"))
    asks = parts.filter("weak").select(*scope, "start", "stop", "kind", "role").distinct().withColumn(
        "bin", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)),
                                     lambda d: d + F.floor(F.col("start") / window).cast("int"))))
    within = F.least(F.abs(F.col("first") - F.col("start")), F.abs(F.col("last") - F.col("start"))) <= window
    same = F.floor(F.col("start") / window).cast("int") == F.col("bin")  # any part of the same bin is near enough
    met = asks.join(near, [*scope, "bin"]).filter((F.col("other") != F.col("role")) & (same | within))
    return met.groupBy(*scope, "start", "stop", "kind", "role").agg(F.count_distinct("other").alias("others"), F.max("other").alias("far"),
                                                                    F.min("other").alias("near")).filter(
        ((F.col("role") == 1) & (F.col("near") <= 2)) | ((F.col("role") == 2) & (F.col("near") == 1)) |
        ((F.col("role") == 3) & (F.col("others") == 2))).select(*scope, "start", "stop", "kind")


def find(reviews: DataFrame, window: int = 200, review_case_id: str = "review_case_id", comment: str = "safe_comment") -> DataFrame:
    """Add ``base_spans`` and ``spans`` to every comment: arrays of (start, stop, kind), kind an index into ``KINDS``.

    ``spans`` holds the certain finds and the weak candidates that are linked, by start and then kind. Positions are code
    points, the end is exclusive. A missing comment is empty and has none. Rows that repeat an id are scopes of their own
    unless their comment is the same too; then they get the same spans. Columns of these names are replaced, all others pass
    through, one row out per row in.
    """
    names = [c for c in reviews.columns if c not in ("base_spans", "spans")]
    text = text_of(comment)
    scanned = reviews.select(*names).withColumn("base_spans", base_spans(text)).withColumn("__weak", weak_spans(text, F.col("base_spans")))
    linkable = (F.size("__weak") > 0) & (F.size(_roles(F.concat("base_spans", "__weak"))) > 1)
    plain = scanned.filter(~linkable).withColumn("spans", F.col("base_spans")).drop("__weak")
    rest = scanned.filter(linkable).withColumn("__digest", F.sha2(text, 256))
    kind_role = F.array(*[F.lit(ROLE[k]) for k in KINDS])
    parts = stage(rest.select(F.col(review_case_id).cast("string").alias("__case"), "__digest", F.explode(F.concat(
        F.transform("base_spans", lambda s: s.withField("weak", F.lit(False))),
        F.transform("__weak", lambda s: s.withField("weak", F.lit(True))))).alias("p")).select(
        F.coalesce("__case", F.lit("")).alias("__case"), "__digest", "p.*").withColumn("role", F.get(kind_role, F.col("kind"))).distinct())
    linked = link(parts, window, ["__case", "__digest"]).groupBy("__case", "__digest").agg(
        F.collect_list(F.struct("start", "stop", "kind")).alias("__linked"))
    joined = rest.withColumn("__case", F.coalesce(F.col(review_case_id).cast("string"), F.lit(""))).join(
        linked, ["__case", "__digest"], "left").withColumn("spans", F.array_sort(
            F.concat("base_spans", F.coalesce("__linked", F.array().cast(SPAN))), _by_start))
    return plain.select(*names, "base_spans", "spans").unionByName(joined.select(*names, "base_spans", "spans"))


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def listed(spans: Column) -> Column:
    """Spans as ``kind:start:end`` joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with every span, or run of overlapping spans, replaced by a mark."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        piece = F.when(s["start"] >= state["at"], F.concat(state["out"], text.substr(state["at"] + 1, s["start"] - state["at"]), F.lit(mark)))
        return F.struct(F.greatest(state["at"], s["stop"]).alias("at"), piece.otherwise(state["out"]).alias("out"))

    return F.when(F.size(spans) > 0, F.aggregate(spans, zero, step, lambda s: F.concat(
        s["out"], text.substr(s["at"] + 1, F.length(text))))).otherwise(text)
