"""Review-loop, validation, catalogue and reconciliation queries with their check SQL."""
from __future__ import annotations

from pyspark.sql import functions as F

from siliscope import constants as C
from siliscope.functions import columns as fc
from siliscope.operators import geometry as gm
from siliscope.operators import review as rv
from siliscope.operators import validation as va
from siliscope.plans import demo
from siliscope.plans.feature_queries import COMPACT, GEO
from siliscope.plans.registry import part, query
from siliscope.plans.search_queries import embedding_neighbors, rounded9, shared_pixels, wafer_features
from siliscope.sources import catalog as cat

FIELDS = list(C.REVIEW_VOCAB)


def sql_list(values):
    return "[" + ", ".join("'" + v + "'" for v in values) + "]"


# reviews derived from the embedding neighbours: values rotate through the vocabularies, some blank, some invalid
_cols = ", ".join(
    f"CASE WHEN (line_no+{i})%13=0 THEN '' WHEN (line_no+{i})%29=0 THEN 'Bad_Value' ELSE "
    f"(CASE WHEN line_no%4=0 THEN ' ' ELSE '' END)||({sql_list(C.REVIEW_VOCAB[f])})[((query_id*31+rank*7)%{len(C.REVIEW_VOCAB[f])})::INT+1] END AS {f}"
    for i, f in enumerate(FIELDS))
part("reviews", f"""SELECT line_no, query_id::VARCHAR||'__rank'||rank::VARCHAR||'__'||neighbor_id::VARCHAR AS review_case_id, query_id::VARCHAR AS query_sample_id,
  CASE WHEN line_no%23=0 THEN 'n/a' WHEN line_no%5=0 THEN rank::VARCHAR||'.0' ELSE rank::VARCHAR END AS rank, neighbor_id::VARCHAR AS neighbor_sample_id, {_cols},
  CASE WHEN line_no%11=0 THEN 'looks like lot ABC'||line_no::VARCHAR||' again' WHEN line_no%17=0 THEN 'see C:/secure/raw'||line_no::VARCHAR||'.npy now' ELSE 'fine' END AS safe_comment
  FROM (SELECT *, query_id*5+rank+1 AS line_no FROM enn)""", ("enn",))


def reviews(spark, sf):
    n = embedding_neighbors(spark, sf).withColumn("line_no", F.col("query_id") * 5 + F.col("rank") + 1)
    line = F.col("line_no")

    def value(i, field):
        vocab = F.array(*[F.lit(v) for v in C.REVIEW_VOCAB[field]])
        pick = F.element_at(vocab, ((F.col("query_id") * 31 + F.col("rank") * 7) % len(C.REVIEW_VOCAB[field]) + 1).cast("int"))
        return (F.when((line + i) % 13 == 0, "").when((line + i) % 29 == 0, "Bad_Value")
                .otherwise(F.concat(F.when(line % 4 == 0, " ").otherwise(""), pick)).alias(field))

    q, r, nb = (F.col(c).cast("string") for c in ("query_id", "rank", "neighbor_id"))
    text = line.cast("string")
    return n.select(
        "line_no", F.concat(q, F.lit("__rank"), r, F.lit("__"), nb).alias("review_case_id"), q.alias("query_sample_id"),
        F.when(line % 23 == 0, "n/a").when(line % 5 == 0, F.concat(r, F.lit(".0"))).otherwise(r).alias("rank"),
        nb.alias("neighbor_sample_id"), *[value(i, f) for i, f in enumerate(FIELDS)],
        F.when(line % 11 == 0, F.concat(F.lit("looks like lot ABC"), text, F.lit(" again")))
        .when(line % 17 == 0, F.concat(F.lit("see C:/secure/raw"), text, F.lit(".npy now"))).otherwise("fine").alias("safe_comment"))


def nsql(f):
    return f"lower(trim({f}))"


DEC = "('" + "','".join(C.REVIEW_DECISIONS) + "')"


@query("s19_review_form", """SELECT query_id::VARCHAR||'__rank'||rank::VARCHAR||'__'||neighbor_id::VARCHAR AS review_case_id, query_id::VARCHAR AS query_sample_id,
  rank::VARCHAR AS rank, neighbor_id::VARCHAR AS neighbor_sample_id, round(distance,6) AS distance, '' AS reviewer_decision, '' AS next_action FROM enn""", ("enn",))
def _(spark, sf):
    n = embedding_neighbors(spark, sf).withColumnsRenamed({"query_id": "query_sample_id", "neighbor_id": "neighbor_sample_id"})
    form = rv.review_form(n)
    return form.select("review_case_id", "query_sample_id", "rank", "neighbor_sample_id",
                       F.round("distance", 6).alias("distance"), "reviewer_decision", "next_action")


@query("v10_duplicate_cases", """SELECT * FROM (SELECT query_id::VARCHAR||'__rank'||rank::VARCHAR||'__'||neighbor_id::VARCHAR AS review_case_id,
   count(*) AS copies FROM (SELECT * FROM enn UNION ALL SELECT * FROM enn WHERE query_id%10=0) GROUP BY 1) WHERE copies>1""", ("enn",))
def _(spark, sf):
    n = embedding_neighbors(spark, sf).withColumnsRenamed({"query_id": "query_sample_id", "neighbor_id": "neighbor_sample_id"})
    return rv.duplicate_cases(rv.review_form(n.unionByName(n.filter("query_sample_id % 10 = 0"))))


@query("v09_invalid_values", " UNION ALL ".join(
    f"SELECT line_no, query_sample_id, neighbor_sample_id, '{f}' AS field, {f} AS value FROM reviews WHERE {nsql(f)}<>'' AND NOT list_contains({sql_list(C.REVIEW_VOCAB[f])}, {nsql(f)})"
    for f in FIELDS), ("reviews",))
def _(spark, sf):
    return rv.invalid_values(reviews(spark, sf))


@query("p25_normalised_review", f"""SELECT line_no, {nsql('reviewer_decision')} AS decision, coalesce(try_cast(trunc(try_cast(rank AS DOUBLE)) AS BIGINT),1000000000) AS rank_no FROM reviews""", ("reviews",))
def _(spark, sf):
    return rv.with_rank_number(reviews(spark, sf)).select(
        "line_no", rv.norm(F.col("reviewer_decision")).alias("decision"), F.col("rank_no").cast("long").alias("rank_no"))


def flag_sql(table, keys, text):
    return " UNION ALL ".join(
        f"SELECT {keys}, '{name}' AS issue, substr(regexp_extract({text}, '{p}'),1,80) AS snippet FROM {table} WHERE regexp_extract({text}, '{p}')<>''"
        for name, p in rv.SENSITIVE_PATTERNS.items())


@query("p27_sensitive_comments", flag_sql("reviews", "line_no, query_sample_id, neighbor_sample_id", "safe_comment"), ("reviews",))
def _(spark, sf):
    return rv.sensitive_flags(reviews(spark, sf), "safe_comment", ["line_no", "query_sample_id", "neighbor_sample_id"])


# every seventh document and fifth conversation turn also says where it was stored
part("pathdocs", "SELECT doc_id, text || CASE WHEN doc_id%7=0 THEN ' kept in /home/'||source||'/'||doc_id::VARCHAR||' for tool X' ELSE '' END AS text FROM documents")
part("pathturns", "SELECT conv_id, turn, text || CASE WHEN (conv_id+turn)%5=0 THEN ' Recipe: '||role||conv_id::VARCHAR ELSE '' END AS text FROM conversations")


def located_documents(spark, sf):
    d = F.col("doc_id")
    tail = F.concat(F.lit(" kept in /home/"), "source", F.lit("/"), d.cast("string"), F.lit(" for tool X"))
    return demo.table(spark, sf, "documents").select(
        "doc_id", F.concat("text", F.when(d % 7 == 0, tail).otherwise(F.lit(""))).alias("text"))


def located_turns(spark, sf):
    tail = F.concat(F.lit(" Recipe: "), "role", F.col("conv_id").cast("string"))
    hit = (F.col("conv_id") + F.col("turn")) % 5 == 0
    return demo.table(spark, sf, "conversations").select(
        "conv_id", "turn", F.concat("text", F.when(hit, tail).otherwise(F.lit(""))).alias("text"))


@query("p27_sensitive_documents", flag_sql("pathdocs", "doc_id", "text"), ("pathdocs",))
def _(spark, sf):
    return rv.sensitive_flags(located_documents(spark, sf), "text", ["doc_id"])


@query("p27_sensitive_conversations", flag_sql("pathturns", "conv_id, turn", "text"), ("pathturns",))
def _(spark, sf):
    return rv.sensitive_flags(located_turns(spark, sf), "text", ["conv_id", "turn"])


LEAK = "CASE " + " ".join(f"WHEN regexp_matches({{t}}, '{p}') THEN '{n}'" for n, p in rv.LEAK_PATTERNS.items()) + " END"


@query("s17_leak_scan", f"SELECT * FROM (SELECT 'document' AS kind, doc_id AS id, {LEAK.format(t='text')} AS finding FROM pathdocs UNION ALL "
       f"SELECT 'page', page_id, {LEAK.format(t='html')} FROM pages) WHERE finding IS NOT NULL", ("pathdocs",))
def _(spark, sf):
    d = located_documents(spark, sf).select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text")
    p = demo.table(spark, sf, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("text"))
    return rv.leak_findings(d.unionByName(p), "text", ["kind", "id"])


part("vrev", f"SELECT *, {nsql('reviewer_decision')} AS d, {nsql('missed_major_defect')} AS m, {nsql('clock_position_match')} AS k, "
     f"coalesce(try_cast(trunc(try_cast(rank AS DOUBLE)) AS BIGINT),1000000000) AS rn FROM reviews WHERE {nsql('reviewer_decision')} IN {DEC}", ("reviews",))
part("revsum", f"""SELECT * FROM (SELECT count(*) AS total_rows, count(DISTINCT query_sample_id) AS query_count, sum(({nsql('reviewer_decision')}<>'')::INT)::BIGINT AS filled_review_rows,
    sum(({nsql('reviewer_decision')}<>'')::INT)::DOUBLE/count(*) AS review_completion_rate FROM reviews),
  (SELECT count(*) AS valid_review_rows, avg((d='same_family')::INT) AS same_family_rate, avg((d='partial_match')::INT) AS partial_match_rate, avg((d='mismatch')::INT) AS mismatch_rate,
    avg((d='not_sure')::INT) AS not_sure_rate, avg((d IN ('same_family','partial_match'))::INT) AS accepted_match_rate, avg((m='yes')::INT) AS missed_major_defect_rate,
    sum((k IN ('yes','partial'))::INT)::DOUBLE/sum((k IN ('yes','partial','no'))::INT) AS clock_position_accept_rate FROM vrev),
  (SELECT count(*) AS reviewed_query_count, avg(s) AS query_topk_same_family_rate, avg(a) AS query_topk_accept_rate, avg(y) AS query_missed_major_defect_rate FROM (
    SELECT query_sample_id, max((d='same_family')::INT) s, max((d IN ('same_family','partial_match'))::INT) a, max((m='yes')::INT) y FROM vrev WHERE rn<=3 GROUP BY 1))""", ("reviews", "vrev"))


@query("a42_review_summary", "SELECT * FROM revsum", ("revsum",))
def _(spark, sf):
    return rv.review_metrics(reviews(spark, sf), 3)


@query("a42_dominant_defects", f"""SELECT dd AS dominant_defect, count(*) AS review_rows, avg((d IN ('same_family','partial_match'))::INT) AS accepted_match_rate,
   avg((d='same_family')::INT) AS same_family_rate, avg((m='yes')::INT) AS missed_major_defect_rate FROM (SELECT *, CASE WHEN {nsql('dominant_defect')}='' THEN 'unknown' ELSE {nsql('dominant_defect')} END AS dd FROM vrev)
   WHERE list_contains({sql_list(C.DEFECT_FAMILIES)}, dd) GROUP BY 1""", ("vrev",))
def _(spark, sf):
    return rv.dominant_defects(reviews(spark, sf))


COUNTED = ["query_defect_family", "neighbor_defect_family", "retrieval_failure_mode", "next_action"]


@query("a42_value_counts", "SELECT field, value, count(*) AS n FROM (" + " UNION ALL ".join(
    f"SELECT '{f}' AS field, {nsql(f)} AS value FROM vrev" for f in COUNTED) + ") WHERE value<>'' GROUP BY 1,2", ("vrev",))
def _(spark, sf):
    return rv.value_counts(reviews(spark, sf), COUNTED)


@query("a43_next_action_queue", f"""SELECT *, row_number() OVER (ORDER BY review_rows DESC, missed_rate DESC, fl) AS position FROM (
  SELECT {nsql('next_action')} AS next_action, coalesce(nullif({nsql('query_defect_family')},''), nullif({nsql('dominant_defect')},''),'unknown') AS defect_family,
   coalesce(nullif({nsql('retrieval_failure_mode')},''),'not_sure') AS failure_mode, count(*) AS review_rows, avg((m='yes')::INT) AS missed_rate, min(line_no) fl,
   min_by(query_sample_id, line_no) AS example_query_sample_id, min_by(neighbor_sample_id, line_no) AS example_neighbor_sample_id
  FROM vrev WHERE {nsql('next_action')} NOT IN ('','keep_baseline','not_sure') GROUP BY 1,2,3)""".replace("SELECT *, row", "SELECT * EXCLUDE (fl), row"), ("vrev",))
def _(spark, sf):
    return rv.next_actions(reviews(spark, sf))


@query("p32_review_verdict", """SELECT CASE WHEN valid_review_rows=0 THEN 'pending' WHEN accepted_match_rate>=0.7 AND missed_major_defect_rate<=0.1 THEN 'promising'
  WHEN missed_major_defect_rate>=0.25 THEN 'misses_major_defects' WHEN mismatch_rate>=0.5 THEN 'disagrees_with_experts' ELSE 'partly_useful' END AS verdict FROM revsum""", ("revsum",))
def _(spark, sf):
    m = rv.review_metrics(reviews(spark, sf), 3)
    return m.select(rv.verdict(F.col("accepted_match_rate"), F.col("missed_major_defect_rate"), F.col("mismatch_rate"),
                               F.col("valid_review_rows")).alias("verdict"))


@query("p26_distance_text", "SELECT query_id, rank, format('{:.6g}', distance) AS distance FROM enn", ("enn",))
def _(spark, sf):
    return embedding_neighbors(spark, sf).select("query_id", "rank", rv.format_distance(F.col("distance").cast("string")).alias("distance"))


PILOT = ", ".join(f"('{n}', '{m}', '{op}', {b})" for n, m, op, b in rv.PILOT_BOUNDS)


@query("v15_pilot_gate", f"""SELECT c.n AS check_name, c.m AS metric, round(v.value,9) AS value, c.b::DOUBLE AS bound, CASE c.op WHEN '>=' THEN v.value>=c.b ELSE v.value<=c.b END AS passed
 FROM (VALUES {PILOT}) c(n,m,op,b) JOIN (SELECT 'reviewed_query_count' AS metric, reviewed_query_count::DOUBLE AS value FROM revsum UNION ALL SELECT 'accepted_match_rate', accepted_match_rate FROM revsum
   UNION ALL SELECT 'query_topk_accept_rate', query_topk_accept_rate FROM revsum UNION ALL SELECT 'query_missed_major_defect_rate', query_missed_major_defect_rate FROM revsum
   UNION ALL SELECT 'parser_issue_count', sum(({nsql('retrieval_failure_mode')}='parser_or_mask_issue')::INT)::DOUBLE FROM vrev
   UNION ALL SELECT 'sensitive_comment_count', count(*)::DOUBLE FROM ({flag_sql('reviews', 'line_no', 'safe_comment')})) v ON v.metric=c.m""", ("revsum", "vrev", "reviews"))
def _(spark, sf):
    r = reviews(spark, sf)
    m = rv.review_metrics(r, 3)
    names = ["reviewed_query_count", "accepted_match_rate", "query_topk_accept_rate", "query_missed_major_defect_rate"]
    narrow = m.select(*[F.col(n).cast("double").alias(n) for n in names]).unpivot([], names, "metric", "value")
    parser = rv.valid_reviews(r).agg(F.count_if(rv.norm(F.col("retrieval_failure_mode")) == "parser_or_mask_issue").cast("double").alias("value"))
    flags = rv.sensitive_flags(r, "safe_comment", ["line_no"]).agg(F.count(F.lit(1)).cast("double").alias("value"))
    every = narrow.unionByName(parser.withColumn("metric", F.lit("parser_issue_count"))).unionByName(
        flags.withColumn("metric", F.lit("sensitive_comment_count")))
    bounds = spark.createDataFrame(list(rv.PILOT_BOUNDS), "check_name string, metric string, op string, bound double")
    return rounded9(va.acceptance(every, bounds))


# ---- wafer validation on a damaged copy of the pixel table
part("cpid", """SELECT p.*, coalesce(c.k,-1) AS chip_id FROM px p LEFT JOIN (SELECT sample_id, chip_row, chip_col, row_number() OVER (PARTITION BY sample_id ORDER BY chip_row, chip_col)-1 AS k
  FROM chips WHERE n_wafer>0) c ON c.sample_id=p.sample_id AND c.chip_row=p.chip_row AND c.chip_col=p.chip_col""", ("px", "chips"))
part("bad", """SELECT * REPLACE (CASE WHEN w%5=1 AND y=12 AND x=12 THEN 9 WHEN w%7=2 AND y=0 AND x=0 THEN 1 ELSE severity END AS severity,
   CASE WHEN w%6=2 AND y=0 AND x=1 THEN 1 ELSE stby END AS stby, CASE WHEN w%8=3 AND y=0 AND x=2 THEN 1 WHEN w%9=4 AND stby=1 THEN 1 WHEN w%11=5 AND y=5 AND x=5 THEN 2 ELSE valid END AS valid,
   CASE WHEN w%10=6 AND chip_row=3 AND chip_col=3 THEN -1 WHEN w%13=7 AND y=0 AND x=3 THEN 99 ELSE chip_id END AS chip_id) FROM cpid""", ("cpid",))


def numbered_pixels(spark, sf):
    px = demo.pixels(spark, sf)
    ids = gm.chip_numbers(gm.chips(px, GEO), "n_wafer").select("sample_id", "chip_row", "chip_col", "chip_id")
    return px.join(ids, ["sample_id", "chip_row", "chip_col"])


def damaged_pixels(spark, sf):
    w, y, x = F.col("w"), F.col("y"), F.col("x")
    at = lambda r, c: (y == r) & (x == c)
    return numbered_pixels(spark, sf).withColumns({
        "severity": F.when((w % 5 == 1) & at(12, 12), 9).when((w % 7 == 2) & at(0, 0), 1).otherwise(F.col("severity")),
        "stby": F.when((w % 6 == 2) & at(0, 1), 1).otherwise(F.col("stby")),
        "valid": F.when((w % 8 == 3) & at(0, 2), 1).when((w % 9 == 4) & (F.col("stby") == 1), 1)
        .when((w % 11 == 5) & at(5, 5), 2).otherwise(F.col("valid")),
        "chip_id": F.when((w % 10 == 6) & (F.col("chip_row") == 3) & (F.col("chip_col") == 3), -1)
        .when((w % 13 == 7) & at(0, 3), 99).otherwise(F.col("chip_id"))})


COMMON = [("severity outside wafer_mask must be 0", "in_wafer=0 AND severity<>0"), ("stby pixels must be inside wafer_mask", "in_wafer=0 AND stby<>0"),
          ("stby pixels must have severity 0", "stby>0 AND severity<>0"), ("stby pixels must be invalid test pixels", "stby>0 AND valid<>0"),
          ("pixels outside wafer must be invalid", "in_wafer=0 AND valid<>0"), ("chip_index outside wafer_mask must be -1", "in_wafer=0 AND chip_id<>-1"),
          ("valid must be binary", "valid NOT IN (0,1)"), ("stby must be binary", "stby NOT IN (0,1)"), ("severity must be in grade range 0..7", "severity NOT BETWEEN 0 AND 7")]
REAL = COMMON + [("severity on invalid-test pixels must be 0", "valid=0 AND severity<>0"), ("chip_index inside wafer_mask must be non-negative", "in_wafer>0 AND chip_id<0")]


def rule_sql(rules, extra=""):
    return " UNION ALL ".join(f"SELECT sample_id, '{t}' AS error FROM bad GROUP BY 1 HAVING max(({c})::INT)>0" for t, c in rules) + extra


DIES = " UNION ALL SELECT sample_id, 'net die does not match chip_index die count' FROM bad GROUP BY 1 HAVING count(DISTINCT CASE WHEN chip_id>=0 THEN chip_id END)<>32"


@query("v01_labelled_sample_errors", rule_sql(COMMON), ("bad",))
def _(spark, sf):
    return va.labelled_sample_errors(damaged_pixels(spark, sf)).select("sample_id", F.explode("errors").alias("error"))


@query("v02_sample_errors", rule_sql(REAL, DIES), ("bad",))
def _(spark, sf):
    return va.sample_sanity(damaged_pixels(spark, sf), GEO).select("sample_id", F.explode("errors").alias("error"))


@query("v02_sample_warnings", """SELECT sample_id, 'stby area is not a multiple of chip area' AS warning FROM bad GROUP BY 1 HAVING sum((stby>0)::INT)%16<>0 UNION ALL
   SELECT sample_id, 'sample has no stby pixels' FROM bad GROUP BY 1 HAVING sum((stby>0)::INT)=0 UNION ALL
   SELECT sample_id, 'wafer mask is an inferred ellipse' FROM bad GROUP BY 1""", ("bad",))
def _(spark, sf):
    px = damaged_pixels(spark, sf).withColumn("mask_strategy", F.lit("centered_ellipse_from_png"))
    return va.sample_sanity(px, GEO).select("sample_id", F.explode("warnings").alias("warning"))


@query("v16_sanity_record", """SELECT sample_id, 24 AS height, 24 AS width, sum((valid>0)::INT)::BIGINT AS valid_pixel_count, sum((stby>0)::INT)::BIGINT AS stby_pixel_count,
   count(DISTINCT CASE WHEN chip_id>=0 THEN chip_id END) AS chip_index_die_count, sum((stby>0)::INT)/16.0::DOUBLE AS stby_chip_count_est, min(severity) AS grade_min, max(severity) AS grade_max FROM bad GROUP BY 1""", ("bad",))
def _(spark, sf):
    return va.sample_sanity(damaged_pixels(spark, sf), GEO).drop("errors", "warnings")


@query("v16_passing_samples", f"SELECT DISTINCT sample_id FROM bad WHERE sample_id NOT IN (SELECT sample_id FROM ({rule_sql(REAL, DIES)}))", ("bad",))
def _(spark, sf):
    return va.passing(va.sample_sanity(damaged_pixels(spark, sf), GEO))


@query("v07_chip_numbers", "SELECT DISTINCT sample_id, chip_row, chip_col, chip_id FROM cpid", ("cpid",))
def _(spark, sf):
    return gm.chip_numbers(gm.chips(demo.pixels(spark, sf), GEO), "n_wafer").select("sample_id", "chip_row", "chip_col", "chip_id")


CODES = "(" + sql_list([str(c) for c in C.GRADE_GRAYS]).replace("'", "") + ")"
part("gray", f"SELECT *, CASE WHEN stby=1 THEN 255 WHEN in_wafer=1 THEN {CODES}[severity+1] ELSE 0 END AS gray FROM px", ("px",))


def gray_pixels(spark, sf):
    return demo.pixels(spark, sf).withColumn("gray", fc.grade_to_gray(F.col("severity"), F.col("in_wafer"), F.col("stby")))


@query("s14_gray_codes", "SELECT sample_id, y, x, gray FROM gray", ("gray",))
def _(spark, sf):
    return gray_pixels(spark, sf).select("sample_id", "y", "x", "gray")


@query("p01_gray_to_grade", f"SELECT sample_id, y, x, list_position({CODES}, gray)-1 AS grade FROM gray", ("gray",))
def _(spark, sf):
    return gray_pixels(spark, sf).select("sample_id", "y", "x", fc.gray_to_grade(F.col("gray")).alias("grade"))


@query("u02_unknown_codes", f"SELECT sample_id, string_agg(g::VARCHAR, ',' ORDER BY g) AS unknown_values FROM (SELECT DISTINCT sample_id, gray+(h%5=4)::INT AS g FROM gray) "
       f"WHERE NOT list_contains({CODES}, g) GROUP BY 1", ("gray",))
def _(spark, sf):
    px = gray_pixels(spark, sf).withColumn("gray", F.col("gray") + (F.col("h") % 5 == 4).cast("int"))
    return va.unknown_grays(px).withColumn("unknown_values", F.array_join("unknown_values", ","))


@query("v05_stby_chips", "SELECT sample_id, chip_row, chip_col, (min(gray)=255)::INT AS stby FROM gray GROUP BY 1,2,3", ("gray",))
def _(spark, sf):
    return va.full_gray_chips(gray_pixels(spark, sf))


@query("s05_assembled_pixels", """SELECT sample_id, y, x, in_wafer, st AS stby, (in_wafer=1 AND st=0)::INT AS valid, CASE WHEN st=1 THEN 0 ELSE gr END AS severity
  FROM (SELECT g.*, c.s AS st, list_position(""" + CODES + """, gray)-1 AS gr FROM gray g JOIN (SELECT sample_id, chip_row, chip_col, (min(gray)=255)::INT AS s FROM gray GROUP BY 1,2,3) c
  ON c.sample_id=g.sample_id AND c.chip_row=g.chip_row AND c.chip_col=g.chip_col)""", ("gray",))
def _(spark, sf):
    from siliscope.sources.images import assemble
    raw = gray_pixels(spark, sf).select("sample_id", F.concat(F.lit("p"), (F.col("w") % 2).cast("string")).alias("product"), "y", "x", "gray", "height", "width")
    geometry = spark.createDataFrame([(p, 4, 4, 6, 6, 32, "centered_ellipse_from_png") for p in ("p0", "p1")],
                                     "product string, chip_h int, chip_w int, rows int, cols int, net_die int, mask_strategy string")
    return assemble(raw, geometry).select("sample_id", "y", "x", "in_wafer", "stby", "valid", "severity")


# ---- catalogue: customers stand for image files, nations for products
part("files", """SELECT n_name AS product, 'root/'||n_name||'/W'||c_custkey::VARCHAR||'.PNG' AS path, 'W'||c_custkey::VARCHAR||'.PNG' AS relative_path, c_custkey,
   24+(c_custkey%50=7)::INT*4 AS height, 24 AS width, c_nationkey FROM customer JOIN nation ON n_nationkey=c_nationkey""")
part("geo", """SELECT CASE WHEN n_nationkey%2=0 THEN n_name ELSE 'alias_'||n_nationkey::VARCHAR END AS product, 4 AS chip_h, 4 AS chip_w, 6 AS rows, 6 AS cols,
   (n_nationkey%5)*8 AS net_die FROM nation WHERE n_nationkey%6<>0""")


def files(spark, sf):
    c, n = demo.table(spark, sf, "customer"), demo.table(spark, sf, "nation")
    key = F.col("c_custkey").cast("string")
    return c.join(n, F.col("n_nationkey") == F.col("c_nationkey")).select(
        F.col("n_name").alias("product"), F.concat(F.lit("root/"), "n_name", F.lit("/W"), key, F.lit(".PNG")).alias("path"),
        F.concat(F.lit("W"), key, F.lit(".PNG")).alias("relative_path"), "c_custkey",
        (24 + (F.col("c_custkey") % 50 == 7).cast("int") * 4).alias("height"), F.lit(24).alias("width"), "c_nationkey")


def geometry(spark, sf):
    k = F.col("n_nationkey")
    return demo.table(spark, sf, "nation").filter(k % 6 != 0).select(
        F.when(k % 2 == 0, F.col("n_name")).otherwise(F.concat(F.lit("alias_"), k.cast("string"))).alias("product"),
        F.lit(4).alias("chip_h"), F.lit(4).alias("chip_w"), F.lit(6).alias("rows"), F.lit(6).alias("cols"),
        ((k % 5) * 8).cast("int").alias("net_die"))


def products(spark, sf):
    return demo.table(spark, sf, "nation").select(F.col("n_name").alias("name"),
                                                  F.concat(F.lit("alias_"), F.col("n_nationkey").cast("string")).alias("alias"))


@query("s06_products", "SELECT product, count(*) AS files FROM files GROUP BY 1", ("files",))
def _(spark, sf):
    full = files(spark, sf).select(F.regexp_replace("path", "^root/", "file:/in/root/").alias("path"))
    return cat.placed_files(full, "file:///in/root").groupBy("product").agg(F.count(F.lit(1)).alias("files"))


@query("s07_first_per_product", "SELECT product, path, place FROM (SELECT *, row_number() OVER (PARTITION BY product ORDER BY path) AS place FROM files) WHERE place<=5", ("files",))
def _(spark, sf):
    return cat.first_per_product(files(spark, sf), 5).select("product", "path", "place")


@query("s08_opaque_ids", "SELECT path, 'product_'||substr(sha256('salt'||product),1,10)||'_w'||substr(sha256(lower(relative_path)),1,10) AS sample_id FROM files", ("files",))
def _(spark, sf):
    full = files(spark, sf).select(F.regexp_replace("path", "^root/", "file:/in/root/").alias("path"))
    return cat.opaque_entries(cat.placed_files(full, "file:///in/root"), "salt").select(
        F.regexp_replace("path", "^file:/in/root/", "root/").alias("path"), "sample_id")


@query("s10_product_geometry", "SELECT name, alias, coalesce(a.net_die,b.net_die) AS net_die, coalesce(a.rows,b.rows) AS rows FROM (SELECT n_name AS name, 'alias_'||n_nationkey::VARCHAR AS alias FROM nation) p "
       "LEFT JOIN geo a ON a.product=p.name LEFT JOIN geo b ON b.product=p.alias", ("geo",))
def _(spark, sf):
    return cat.product_geometry(products(spark, sf), geometry(spark, sf)).select("name", "alias", "net_die", "rows")


@query("j07_geometry_lookup", "SELECT f.path, coalesce(a.net_die,b.net_die) AS net_die FROM files f LEFT JOIN geo a ON a.product=f.product LEFT JOIN geo b ON b.product='alias_'||f.c_nationkey::VARCHAR", ("files", "geo"))
def _(spark, sf):
    g = cat.product_geometry(products(spark, sf), geometry(spark, sf)).select(F.col("name").alias("product"), "net_die")
    return files(spark, sf).join(g, "product", "left").select("path", "net_die")


@query("v11_production_gate", "SELECT * FROM (SELECT name, alias, CASE WHEN a.product IS NULL AND b.product IS NULL THEN 'geometry missing' WHEN coalesce(a.net_die,b.net_die)<=0 THEN 'net die not positive' END AS issue "
       "FROM (SELECT n_name AS name, 'alias_'||n_nationkey::VARCHAR AS alias FROM nation) p LEFT JOIN geo a ON a.product=p.name LEFT JOIN geo b ON b.product=p.alias) WHERE issue IS NOT NULL", ("geo",))
def _(spark, sf):
    return va.production_gate(products(spark, sf), geometry(spark, sf))


@query("u03_missing_products", "SELECT DISTINCT product FROM files WHERE product NOT IN (SELECT product FROM geo)", ("files", "geo"))
def _(spark, sf):
    return files(spark, sf).select("product").subtract(geometry(spark, sf).select("product"))


@query("s15_batch_metadata", """SELECT count(*) AS product_count, sum(n)::BIGINT AS sample_count, count(g.product) AS explicit_geometry_count, sum((g.net_die>0)::INT)::BIGINT AS positive_net_die_count,
   count(g.product)::DOUBLE/count(*) AS explicit_share FROM (SELECT product, count(*) n FROM files GROUP BY 1) f LEFT JOIN geo g ON g.product=f.product""", ("files", "geo"))
def _(spark, sf):
    return cat.batch_metadata(files(spark, sf), geometry(spark, sf))


@query("s18_shape_mismatches", "SELECT f.product, path, height, width, 24 AS eh, 24 AS ew FROM files f JOIN geo g ON g.product=f.product WHERE height<>24", ("files", "geo"))
def _(spark, sf):
    return va.shape_mismatches(files(spark, sf), geometry(spark, sf))


@query("s18_inconsistent_geometry", """SELECT product, count(*) AS geometries, sum(n)::BIGINT AS files FROM (SELECT product, rows, count(*) n FROM (SELECT *, height//4 AS rows FROM files) GROUP BY 1,2) GROUP BY 1 HAVING count(*)>1""", ("files",))
def _(spark, sf):
    inferred = files(spark, sf).select("product", F.lit(4).alias("chip_w"), F.lit(4).alias("chip_h"),
                                       F.floor(F.col("height") / 4).cast("int").alias("rows"), F.lit(6).alias("cols"))
    return va.inconsistent_geometry(inferred)


@query("v06_wafer_mask", """SELECT product, chip_row, chip_col, (CASE WHEN net_die>0 THEN k<=net_die ELSE r2<=1 END)::INT AS in_wafer FROM (SELECT *, row_number() OVER (PARTITION BY product ORDER BY r2, chip_row, chip_col) k FROM (
   SELECT g.product, g.net_die, r.v AS chip_row, c.v AS chip_col, pow(((c.v+0.5::DOUBLE)/6-0.5)*2,2)+pow(((r.v+0.5::DOUBLE)/6-0.5)*2,2) AS r2
   FROM geo g, (SELECT unnest(range(6))::INT v) r, (SELECT unnest(range(6))::INT v) c))""", ("geo",))
def _(spark, sf):
    g = geometry(spark, sf).withColumn("mask_strategy", F.lit("centered_ellipse_from_png"))
    return gm.inferred_wafer_chips(g).select("product", "chip_row", "chip_col", "in_wafer")


part("mani", """SELECT o_orderkey, CASE WHEN o_orderkey%17=0 THEN 'bad id '||o_orderkey::VARCHAR WHEN o_orderkey%19=0 THEN 'dup.id' ELSE
    'product_'||substr(sha256((o_custkey%25)::VARCHAR),1,10)||'_w'||substr(sha256(o_orderkey::VARCHAR),1,10) END AS sample_id,
  CASE o_orderkey%5 WHEN 0 THEN 'npz_semantic_arrays' WHEN 1 THEN 'png_grayscale_raw' WHEN 2 THEN 'png_grayscale_raw' WHEN 3 THEN 'synthetic_sample_dir' ELSE CASE WHEN o_orderkey%25=4 THEN 'video' ELSE 'npz_semantic_arrays' END END AS source_type,
  o_orderkey%7<>1 AS pseudonymized, CASE WHEN o_orderkey%11<>2 THEN 'p.png' END AS png_path, CASE WHEN o_orderkey%13<>3 THEN 'a.npz' END AS arrays_npz, o_orderkey%23<>4 AS has_dir, o_orderkey%3<>0 AS has_geo, o_orderkey%2=0 AS infer FROM orders""")


def manifest(spark, sf):
    k = F.col("o_orderkey")
    s = k.cast("string")
    blocks, grid = F.struct(F.lit(4).alias("width"), F.lit(4).alias("height")), F.struct(F.lit(6).alias("rows"), F.lit(6).alias("cols"))
    return demo.table(spark, sf, "orders").select(
        F.lit(C.MANIFEST_VERSION).alias("schema_version"), F.lit(C.FEATURE_VERSION).alias("feature_schema_version"),
        F.when(k % 17 == 0, F.concat(F.lit("bad id "), s)).when(k % 19 == 0, "dup.id").otherwise(F.concat(
            F.lit("product_"), F.substring(F.sha2((F.col("o_custkey") % 25).cast("string"), 256), 1, 10), F.lit("_w"),
            F.substring(F.sha2(s, 256), 1, 10))).alias("sample_id"),
        F.when((k % 5 == 1) | (k % 5 == 2), C.SOURCE_PNG).when(k % 5 == 3, C.SOURCE_DIR)
        .when(k % 25 == 4, "video").otherwise(C.SOURCE_NPZ).alias("source_type"),
        (k % 7 != 1).alias("pseudonymized"), F.when(k % 11 != 2, "p.png").alias("png_path"),
        F.when(k % 13 != 3, "a.npz").alias("arrays_npz"), F.when(k % 23 != 4, "d").alias("sample_dir"),
        F.lit("x").alias("parser_name"), F.lit("1").alias("parser_version"), F.lit("up").alias("orientation"),
        F.when(k % 3 != 0, blocks).alias("chip_blocks"), F.when(k % 3 != 0, grid).alias("grid"),
        (k % 2 == 0).alias("allow_geometry_inference"))


REALSRC = "source_type IN ('npz_semantic_arrays','png_grayscale_raw')"
MRULES = [("unsupported source_type", "source_type='video'"), ("sample_id has other than letters, numbers and ._-", "NOT regexp_matches(sample_id,'^[A-Za-z0-9_.-]+$')"),
          ("duplicate sample_id", "count(*) OVER (PARTITION BY sample_id)>1"), ("sample_id is not opaque", f"{REALSRC} AND NOT regexp_matches(sample_id,'^product_[0-9a-f]{{10}}_w[0-9a-f]{{10}}$')"),
          ("not pseudonymized", f"{REALSRC} AND NOT pseudonymized"), ("geometry missing", "source_type='png_grayscale_raw' AND NOT has_geo AND NOT infer"),
          ("png_grayscale_raw needs png_path", "source_type='png_grayscale_raw' AND png_path IS NULL"), ("npz_semantic_arrays needs arrays_npz", "source_type='npz_semantic_arrays' AND arrays_npz IS NULL"),
          ("npz_semantic_arrays needs chip_blocks", "source_type='npz_semantic_arrays' AND NOT has_geo"), ("npz_semantic_arrays needs grid", "source_type='npz_semantic_arrays' AND NOT has_geo"),
          ("synthetic_sample_dir needs sample_dir", "source_type='synthetic_sample_dir' AND NOT has_dir")]


@query("v03_manifest_errors", " UNION ALL ".join(f"SELECT sample_id, source_type, '{t}' AS error FROM (SELECT *, {c} AS hit FROM mani) WHERE hit" for t, c in MRULES), ("mani",))
def _(spark, sf):
    return va.manifest_errors(manifest(spark, sf)).select("sample_id", "source_type", F.explode("errors").alias("error"))


@query("s09_manifest_entries", "SELECT sample_id, source_type, 'real_unlabeled_manifest/v1' AS schema_version FROM mani", ("mani",))
def _(spark, sf):
    lines = cat.manifest_lines(manifest(spark, sf).drop("schema_version", "feature_schema_version"))
    return lines.select("schema_version", F.explode("samples").alias("s")).select("s.sample_id", "s.source_type", "schema_version")


@query("s21_score_manifest", "SELECT product, path, place FROM (SELECT *, row_number() OVER (PARTITION BY product ORDER BY path) AS place FROM files) WHERE place<=2", ("files",))
def _(spark, sf):
    return cat.first_per_product(files(spark, sf), 2).select("product", "path", "place")


@query("v04_resolved_geometry", """SELECT p_partkey, CASE WHEN k=0 THEN 4 WHEN k=1 AND h%6=0 AND w%6=0 THEN h//6 WHEN k=2 THEN 4 END AS chip_h,
   CASE WHEN k=0 THEN 6 WHEN k=1 THEN 6 WHEN k=2 AND h%4=0 AND w%4=0 THEN h//4 END AS rows,
   concat_ws('|', CASE WHEN k=1 AND NOT (h%6=0 AND w%6=0) THEN 'grid must evenly divide the image' END, CASE WHEN k=3 THEN 'chip_blocks or grid needed' END,
     CASE WHEN k=2 AND NOT (h%4=0 AND w%4=0) THEN 'chip_blocks must evenly divide the image' END, CASE WHEN k=0 AND (h<>24 OR w<>24) THEN 'geometry must exactly match the image' END) AS errors
   FROM (SELECT p_partkey, (p_partkey%4)::INT AS k, (24+p_size%7)::INT AS h, (24+p_size%5)::INT AS w FROM part)""")
def _(spark, sf):
    k = F.col("p_partkey") % 4
    e = demo.table(spark, sf, "part").select(
        "p_partkey", (24 + F.col("p_size") % 7).cast("int").alias("height"), (24 + F.col("p_size") % 5).cast("int").alias("width"),
        F.when((k == 0) | (k == 2), F.struct(F.lit(4).alias("width"), F.lit(4).alias("height"))).alias("chip_blocks"),
        F.when((k == 0) | (k == 1), F.struct(F.lit(6).alias("rows"), F.lit(6).alias("cols"))).alias("grid"))
    return va.resolved_geometry(e).select("p_partkey", "chip_h", "rows", F.array_join("errors", "|").alias("errors"))


@query("s10_geometry_errors", """SELECT p_partkey, concat_ws('|', CASE WHEN p_size%5=0 THEN 'chip_blocks must be positive' END, CASE WHEN p_size%7=0 THEN 'grid must be positive' END,
    CASE WHEN p_size%11-3<0 THEN 'net die must be non-negative' END, CASE WHEN p_size%11-3>(p_size%7)*2 THEN 'net die exceeds the grid' END) AS errors FROM part""")
def _(spark, sf):
    s = F.col("p_size")
    raw = demo.table(spark, sf, "part").select(
        "p_partkey", F.struct((s % 5).cast("int").alias("width"), F.lit(4).alias("height")).alias("chip_blocks"),
        F.struct((s % 7).cast("int").alias("rows"), F.lit(2).alias("cols")).alias("grid"), (s % 11 - 3).cast("int").alias("actual_net_die"))
    return va.geometry_rows(raw).select("p_partkey", F.array_join("errors", "|").alias("errors"))


@query("p33_normalised_metadata", """SELECT event_id, coalesce(CASE WHEN event_id%3=0 THEN event_type END, CASE WHEN event_id%2=0 THEN 'meta_'||event_id::VARCHAR END, 'real_png_unlabeled') AS sample_id,
   coalesce(CASE WHEN event_id%5=0 THEN 7 END, CASE WHEN event_id%2=0 THEN (event_id%100)::INT END, 0) AS actual_net_die,
   CASE WHEN event_id%4=0 THEN 'full_grid_from_png' ELSE 'centered_ellipse_from_png' END AS wafer_mask_strategy,
   (24+event_id%3)::INT AS height, 24 AS width, (2+event_id%2)::INT AS chip_w, 6 AS rows FROM events""")
def _(spark, sf):
    e = F.col("event_id")
    doc = F.to_json(F.struct(F.concat(F.lit("meta_"), e.cast("string")).alias("sample_id"), (e % 100).cast("int").alias("actual_net_die")))
    entries = demo.table(spark, sf, "events").select(
        "event_id", F.when(e % 3 == 0, F.col("event_type")).alias("sample_id"), F.when(e % 5 == 0, 7).alias("actual_net_die"),
        F.when(e % 2 == 0, doc).alias("metadata_json"), F.when(e % 4 == 0, "full_grid_from_png").alias("wafer_mask_strategy"),
        (24 + e % 3).cast("int").alias("height"), F.lit(24).alias("width"),
        F.struct((2 + e % 2).cast("int").alias("width"), F.lit(4).alias("height")).alias("chip_blocks"), F.struct(F.lit(6).alias("rows"), F.lit(6).alias("cols")).alias("grid"))
    return cat.normalised_metadata(entries, keep=("event_id",)).select(
        "event_id", "sample_id", "actual_net_die", "wafer_mask_strategy", "image_shape.height", "image_shape.width",
        F.col("chip_blocks.width").alias("chip_w"), F.col("grid.rows").alias("rows"))


@query("s16_reconciliation", """SELECT name, rule, expected, found, CASE rule WHEN 'exact' THEN found=expected ELSE found>=expected END AS passed FROM (
   SELECT 'features' AS name, 'exact' AS rule, (SELECT count(DISTINCT sample_id) FROM px) AS expected, (SELECT count(*) FROM f_global) AS found UNION ALL
   SELECT 'labelled documents', 'exact', (SELECT count(*) FROM documents), (SELECT count(*) FROM labels) UNION ALL
   SELECT 'neighbors', 'minimum', (SELECT count(*) FROM embeddings), (SELECT count(*) FROM enn))""", ("px", "f_global", "enn"))
def _(spark, sf):
    def n(df):
        return df.agg(F.count(F.lit(1)).alias("n"))

    def check(name, rule, expected, found):
        return n(expected).select(F.lit(name).alias("name"), F.lit(rule).alias("rule"), F.col("n").alias("expected"), n(found).scalar().alias("found"))
    px = shared_pixels(spark, sf)
    rows = (check("features", "exact", px.select("sample_id").distinct(), wafer_features(spark, sf))
            .unionByName(check("labelled documents", "exact", demo.table(spark, sf, "documents"), demo.table(spark, sf, "labels")))
            .unionByName(check("neighbors", "minimum", demo.table(spark, sf, "embeddings"), embedding_neighbors(spark, sf))))
    return va.reconcile(rows)


@query("a44_status_rollup", """SELECT sum((s='PASS')::INT)::BIGINT AS pass, sum((s='CHECK')::INT)::BIGINT AS "check", sum((s='PENDING')::INT)::BIGINT AS pending,
   CASE WHEN sum((s='PENDING')::INT)>0 THEN 'PENDING' WHEN sum((s='CHECK')::INT)>0 THEN 'CHECK' ELSE 'PASS' END AS overall_status
   FROM (SELECT CASE o_orderstatus WHEN 'F' THEN 'PASS' WHEN 'O' THEN 'CHECK' ELSE 'PENDING' END AS s FROM orders)""")
def _(spark, sf):
    s = F.col("o_orderstatus")
    return va.overall_status(demo.table(spark, sf, "orders").select(
        F.when(s == "F", "PASS").when(s == "O", "CHECK").otherwise("PENDING").alias("status")))


part("drift", """SELECT feature, qm AS query_mean, rm AS reference_mean, greatest(rs,1e-6) AS reference_std, (qm-rm)/greatest(rs,1e-6) AS z_delta FROM (
   SELECT feature, avg(CASE WHEN wn%2=1 THEN v END) qm, avg(CASE WHEN wn%2=0 THEN v END) rm, stddev_pop(CASE WHEN wn%2=0 THEN v END) rs FROM (
     SELECT feature, v, substr(sample_id,2)::BIGINT AS wn FROM (UNPIVOT (SELECT sample_id, """ + ", ".join(COMPACT) + """ FROM f_compact) ON """ + ", ".join(COMPACT) + """ INTO NAME feature VALUE v)) GROUP BY 1)""", ("f_compact",))


@query("a32_feature_drift", "SELECT feature, round(query_mean,6) AS query_mean, round(reference_mean,6) AS reference_mean, round(reference_std,6) AS reference_std, round(z_delta,6) AS z_delta "
       "FROM drift ORDER BY round(abs(z_delta),9) DESC, feature LIMIT 12", ("drift",))
def _(spark, sf):
    f = wafer_features(spark, sf).withColumn("wn", F.substring("sample_id", 2, 9).cast("long"))
    d = va.feature_drift(f.filter("wn % 2 = 1"), f.filter("wn % 2 = 0"), COMPACT)
    return d.select("feature", *[F.round(c, 6).alias(c) for c in ("query_mean", "reference_mean", "reference_std", "z_delta")])


