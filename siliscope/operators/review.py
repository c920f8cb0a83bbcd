"""The expert review loop: forms from neighbour tables, checks of what comes back, summary and next actions."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siliscope import constants as C
from siliscope.functions.columns import safe_div
from siliscope.operators.ordering import row_index

ACCEPTED = ("same_family", "partial_match")

# fixed values: what a comment must not contain
SENSITIVE_PATTERNS = {
    "windows_path": r"[A-Za-z]:[\\/][^\s]+",
    "unc_path": r"\\\\[^\s]+",
    "unix_sensitive_path": r"/(?:home|mnt|data|secure|Users)/[^\s]+",
    "lot_identifier": r"(?i)\blot\s*[:=_-]?\s*[A-Za-z0-9_.-]+",
    "wafer_identifier": r"(?i)\bwafer\s*[:=_-]?\s*[A-Za-z0-9_.-]+",
    "tool_identifier": r"(?i)\btool\s*[:=_-]?\s*[A-Za-z0-9_.-]+",
    "recipe_identifier": r"(?i)\brecipe\s*[:=_-]?\s*[A-Za-z0-9_.-]+",
    "chamber_identifier": r"(?i)\bchamber\s*[:=_-]?\s*[A-Za-z0-9_.-]+",
}
# fixed values: what a shareable file must not contain, the first hit in this order is reported
LEAK_PATTERNS = {
    "private manifest key": r'"(?:png_path|arrays_npz|metadata_json)"\s*:',
    "workspace override flag": r'"allow_workspace_input"\s*:\s*true',
    "absolute Windows path": r"[A-Za-z]:(?:\\\\|/)",
    "absolute user path": r"(?:/home/|/Users/)",
}


def norm(value: Column) -> Column:
    return F.lower(F.trim(F.coalesce(value, F.lit(""))))


def with_rank_number(reviews: DataFrame) -> DataFrame:
    """Whole number of a rank text, or a very large one."""
    return reviews.withColumn("rank_no", F.coalesce(F.expr("try_cast(try_cast(rank AS DOUBLE) AS BIGINT)"),
                                                    F.lit(10 ** 9)))


def format_distance(distance: Column) -> Column:
    """Six significant digits without trailing zeros, as a spreadsheet would show them; other text is kept."""
    value = distance.try_cast("double")
    rounded = F.format_string("%.5e", value)
    mantissa, power = F.split(rounded, "e")[0], F.split(rounded, "e")[1].cast("int")
    trimmed = F.regexp_replace(F.regexp_replace(mantissa, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    scientific = F.concat(trimmed, F.when(power < 0, "e-").otherwise("e+"), F.lpad(F.abs(power).cast("string"), 2, "0"))
    plain = F.regexp_replace(F.regexp_replace(
        F.format_number(rounded.cast("double"), 10), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    plain = F.regexp_replace(plain, ",", "")
    text = F.when(value == 0, F.lit("0")).when((power < -4) | (power >= 6), scientific).otherwise(plain)
    return F.when(value.isNull(), F.coalesce(distance, F.lit(""))).otherwise(text)


def review_form(neighbors: DataFrame) -> DataFrame:
    """One blank review row per neighbour row; label columns are never copied, so they cannot sway a reviewer.

    A table without the columns of neighbours is refused.
    """
    missing, _ = form_problems(neighbors.columns)
    if missing:
        raise ValueError(f"neighbour columns are missing: {missing}")
    q, r, n = (F.trim(F.col(c).cast("string")) for c in ("query_sample_id", "rank", "neighbor_sample_id"))
    blank = [F.lit("").alias(c) for c in C.REVIEW_COLUMNS[5:]]
    return neighbors.select(F.concat(q, F.lit("__rank"), r, F.lit("__"), n).alias("review_case_id"),
                            q.alias("query_sample_id"), r.alias("rank"), n.alias("neighbor_sample_id"),
                            F.col("distance").alias("distance"), *blank)


def form_problems(columns: list[str]) -> tuple[list[str], list[str]]:
    """Required neighbour columns that are missing, and label columns that will be left out."""
    return ([c for c in C.NEIGHBOR_COLUMNS if c not in columns], [c for c in columns if c.startswith("label_")])


def duplicate_cases(form: DataFrame) -> DataFrame:
    return form.groupBy("review_case_id").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def vocabulary(spark) -> DataFrame:
    return spark.createDataFrame([(f, v) for f, vs in C.REVIEW_VOCAB.items() for v in vs], "field string, value string")


def invalid_values(reviews: DataFrame) -> DataFrame:
    """Filled fields whose value is outside the field's vocabulary."""
    fields = list(C.REVIEW_VOCAB)
    long = reviews.unpivot(["line_no", "query_sample_id", "neighbor_sample_id"], fields, "field", "raw")
    filled = long.withColumn("value", norm(F.col("raw"))).filter(F.col("value") != "")
    return (filled.join(F.broadcast(vocabulary(reviews.sparkSession)), ["field", "value"], "left_anti")
            .select("line_no", "query_sample_id", "neighbor_sample_id", "field", F.col("raw").alias("value")))


def sensitive_flags(rows: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """One row per text and pattern found, with the first eighty characters of the hit; whole texts are searched."""
    hits = F.array(*[F.struct(F.lit(name).alias("issue"), F.regexp_substr(F.col(text), F.lit(pattern)).alias("hit"))
                     for name, pattern in SENSITIVE_PATTERNS.items()])
    return (rows.select(*keys, F.explode(hits).alias("h")).filter(F.col("h.hit").isNotNull() & (F.col("h.hit") != ""))
            .select(*keys, F.col("h.issue").alias("issue"), F.substring("h.hit", 1, 80).alias("snippet")))


def leak_findings(files: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """First kind of leak per file."""
    first = F.coalesce(*[F.when(F.col(text).rlike(p), F.lit(name)) for name, p in LEAK_PATTERNS.items()])
    return files.select(*keys, first.alias("finding")).filter(F.col("finding").isNotNull())


def _is(field: str, *values: str) -> Column:
    return norm(F.col(field)).isin(*values)


def valid_reviews(reviews: DataFrame) -> DataFrame:
    return reviews.filter(_is("reviewer_decision", *C.REVIEW_DECISIONS))


def review_metrics(reviews: DataFrame, top_k: int) -> DataFrame:
    """The review loop on one row: row-level rates, and query-level rates over ranks up to ``top_k``."""
    filled, valid = norm(F.col("reviewer_decision")) != "", _is("reviewer_decision", *C.REVIEW_DECISIONS)
    clock = valid & _is("clock_position_match", "yes", "partial", "no")
    n_valid = F.count_if(valid)
    rows = reviews.agg(
        F.count(F.lit(1)).alias("total_rows"), F.countDistinct("query_sample_id").alias("query_count"),
        F.count_if(filled).alias("filled_review_rows"), n_valid.alias("valid_review_rows"),
        safe_div(F.count_if(filled), F.count(F.lit(1))).alias("review_completion_rate"),
        *[safe_div(F.count_if(_is("reviewer_decision", d)), n_valid).alias(f"{n}_rate") for d, n in (
            ("same_family", "same_family"), ("partial_match", "partial_match"), ("mismatch", "mismatch"), ("not_sure", "not_sure"))],
        safe_div(F.count_if(_is("reviewer_decision", *ACCEPTED)), n_valid).alias("accepted_match_rate"),
        safe_div(F.count_if(valid & _is("missed_major_defect", "yes")), n_valid).alias("missed_major_defect_rate"),
        safe_div(F.count_if(clock & _is("clock_position_match", "yes", "partial")), F.count_if(clock)).alias("clock_position_accept_rate"))
    top = with_rank_number(valid_reviews(reviews)).filter(F.col("rank_no") <= top_k)
    queries = top.groupBy("query_sample_id").agg(
        F.max(_is("reviewer_decision", "same_family").cast("int")).alias("same"),
        F.max(_is("reviewer_decision", *ACCEPTED).cast("int")).alias("accept"),
        F.max(_is("missed_major_defect", "yes").cast("int")).alias("missed"))
    n = F.count(F.lit(1))
    per_query = queries.agg(F.struct(
        n.alias("reviewed_query_count"), safe_div(F.coalesce(F.sum("same"), F.lit(0)), n).alias("query_topk_same_family_rate"),
        safe_div(F.coalesce(F.sum("accept"), F.lit(0)), n).alias("query_topk_accept_rate"),
        safe_div(F.coalesce(F.sum("missed"), F.lit(0)), n).alias("query_missed_major_defect_rate")).alias("q"))
    return rows.withColumn("q", per_query.scalar()).select("*", "q.*").drop("q")


def verdict(accepted: Column, missed: Column, mismatch: Column, valid_rows: Column) -> Column:
    """Short verdict on a review round."""
    return (F.when(valid_rows == 0, "pending").when((accepted >= 0.7) & (missed <= 0.1), "promising")
            .when(missed >= 0.25, "misses_major_defects").when(mismatch >= 0.5, "disagrees_with_experts")
            .otherwise("partly_useful"))


def strength(lift: Column) -> Column:
    return F.when(lift >= 1.35, "strong").when(lift >= 1.10, "moderate").otherwise("weak")


def dominant_defects(reviews: DataFrame) -> DataFrame:
    value = norm(F.col("dominant_defect"))
    defect = F.when(value == "", "unknown").otherwise(value)
    n = F.count(F.lit(1))
    return (valid_reviews(reviews).withColumn("defect", defect).filter(F.col("defect").isin(*C.DEFECT_FAMILIES))
            .groupBy(F.col("defect").alias("dominant_defect"))
            .agg(n.alias("review_rows"), safe_div(F.count_if(_is("reviewer_decision", *ACCEPTED)), n).alias("accepted_match_rate"),
                 safe_div(F.count_if(_is("reviewer_decision", "same_family")), n).alias("same_family_rate"),
                 safe_div(F.count_if(_is("missed_major_defect", "yes")), n).alias("missed_major_defect_rate")))


def value_counts(reviews: DataFrame, fields: list[str]) -> DataFrame:
    long = valid_reviews(reviews).unpivot([], fields, "field", "raw").withColumn("value", norm(F.col("raw")))
    return long.filter(F.col("value") != "").groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))


def next_actions(reviews: DataFrame) -> DataFrame:
    """Grouped action requests with their first example; ``position`` orders them by rows, then missed rate."""
    def filled(field: str) -> Column:
        return F.nullif(norm(F.col(field)), F.lit(""))
    rows = (valid_reviews(reviews).withColumn("action", filled("next_action"))
            .filter(F.col("action").isNotNull() & ~F.col("action").isin("keep_baseline", "not_sure")))
    n = F.count(F.lit(1))
    grouped = rows.groupBy(
        F.col("action").alias("next_action"),
        F.coalesce(filled("query_defect_family"), filled("dominant_defect"), F.lit("unknown")).alias("defect_family"),
        F.coalesce(filled("retrieval_failure_mode"), F.lit("not_sure")).alias("failure_mode")).agg(
        n.alias("review_rows"), safe_div(F.count_if(_is("missed_major_defect", "yes")), n).alias("missed_rate"),
        F.min_by("query_sample_id", "line_no").alias("example_query_sample_id"),
        F.min_by("neighbor_sample_id", "line_no").alias("example_neighbor_sample_id"), F.min("line_no").alias("first_line"))
    # actions are free text, so the groups are numbered without one window over all of them; first lines are unique
    placed = row_index(grouped.withColumns({"_rows": -F.col("review_rows"), "_missed": -F.col("missed_rate")}),
                       ["_rows", "_missed", "first_line"], "position")
    return placed.withColumn("position", (F.col("position") + 1).cast("int")).drop("first_line", "_rows", "_missed")


# fixed values: bounds of the pilot
PILOT_BOUNDS = (("reviewed_queries", "reviewed_query_count", ">=", 20.0), ("accepted_rate", "accepted_match_rate", ">=", 0.70),
                ("topk_accept_rate", "query_topk_accept_rate", ">=", 0.80), ("missed_rate", "query_missed_major_defect_rate", "<=", 0.05),
                ("parser_issues", "parser_issue_count", "<=", 0.0), ("sensitive_comments", "sensitive_comment_count", "<=", 0.0))
