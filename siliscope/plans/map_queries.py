"""Pooling, proposal, statistics and lot-hotspot queries with their check SQL."""
from __future__ import annotations

from pyspark.sql import functions as F

from siliscope import constants as C
from siliscope.functions import columns as fc
from siliscope.operators import features as ft
from siliscope.operators import hotspots as hs
from siliscope.operators import ordering
from siliscope.operators import pooling as pl
from siliscope.operators import proposals as pr
from siliscope.operators import search
from siliscope.operators import statistics as st
from siliscope.operators import validation as va
from siliscope.operators import retrieval as rt
from siliscope.plans import demo
from siliscope.sources.staging import stage
from siliscope.plans.feature_queries import COMPACT, polar, rounded
from siliscope.plans.registry import part, query
from siliscope.plans.search_queries import (K, SIG, jac, rounded9, shared_pixels, space_nn_sql, staged_once, wafer_features, wafer_signatures)

G, W = 12, 3
R, A = 8, 24


def r9(names):
    return ", ".join(f"round({n}, 9) AS {n}" for n in names)


# ---- pooling
part("pool", f"""SELECT sample_id, (((y+1)*{G}-1)//24)::INT AS gy, (((x+1)*{G}-1)//24)::INT AS gx, count(*) area, sum(in_wafer) n_wafer, sum(valid) n_valid, sum(in_wafer*stby) n_stby,
   sum(in_wafer*valid) n_wafer_valid, sum(valid*severity) sev_sum, sum(severity) sev_all, max(valid*severity) sev_max, sum((valid=1 AND severity>0)::INT) n_fail, sum((valid=1 AND severity>=6)::INT) n_high,
   sum(CASE WHEN stby=1 THEN 7 WHEN in_wafer=1 THEN severity ELSE 0 END) image_sum, max(in_wafer) any_in_wafer, max(valid) any_valid, max(stby) any_stby,
   {', '.join(f'max({c}) any_{c}, sum({c}) n_{c}' for c in C.PATTERN_CLASSES)} FROM px GROUP BY 1,2,3""", ("px",))
CH = ["severity", "severity_peak", "fail", "high", "stby", "valid", "wafer", "outer"]
part("maps", """SELECT sample_id, gy, gx, sev_sum::DOUBLE/greatest(1,n_valid)/7.0::DOUBLE AS severity, sev_max/7.0::DOUBLE AS severity_peak, n_fail::DOUBLE/greatest(1,n_valid) AS fail,
   n_high::DOUBLE/greatest(1,n_valid) AS high, n_stby::DOUBLE/greatest(1,n_wafer) AS stby, n_wafer_valid::DOUBLE/greatest(1,n_wafer) AS valid, n_wafer::DOUBLE/area AS wafer,
   least(sqrt(((gy-5.5)/5.5)*((gy-5.5)/5.5)+((gx-5.5)/5.5)*((gx-5.5)/5.5)),1.0) AS "outer" FROM pool""", ("pool",))


def cells(spark, sf):
    return pl.pooled(shared_pixels(spark, sf), G, C.PATTERN_CLASSES)


def maps(spark, sf):
    return pl.semantic_maps(cells(spark, sf), G)


@query("a16_pooled_means", 'SELECT sample_id, gy, gx, severity, fail, high, stby, wafer, round("outer",9) AS outer_radius FROM maps', ("maps",))
def _(spark, sf):
    return maps(spark, sf).select("sample_id", "gy", "gx", "severity", "fail", "high", "stby", "wafer", F.round("outer", 9).alias("outer_radius"))


@query("a17_pooled_max", "SELECT sample_id, gy, gx, severity_peak FROM maps", ("maps",))
def _(spark, sf):
    return maps(spark, sf).select("sample_id", "gy", "gx", "severity_peak")


def flat_sql(channels):
    parts = [f"SELECT sample_id AS id, ({i * G * G}+gy*{G}+gx)::INT AS pos, ({e})::DOUBLE AS v FROM {t}" for i, (t, e) in enumerate(channels)]
    return " UNION ALL ".join(parts)


TENSOR = [("pool", "sev_all::DOUBLE/(7.0::DOUBLE*area)"), ("pool", "any_in_wafer"), ("pool", "any_valid"), ("pool", "any_stby")]


def exploded(df):
    return df.select("id", F.posexplode("vec").alias("pos", "v"))


@query("a18_input_tensor", flat_sql(TENSOR), ("pool",))
def _(spark, sf):
    return exploded(pl.input_tensor(cells(spark, sf), G))


@query("a18_target_tensor", flat_sql([("pool", f"any_{c}") for c in C.REPORT_CLASSES]), ("pool",))
def _(spark, sf):
    return exploded(pl.target_tensor(cells(spark, sf), G, C.REPORT_CLASSES))


@query("a19_gray_vector", flat_sql([("pool", "image_sum::DOUBLE/(7.0::DOUBLE*area)")]), ("pool",))
def _(spark, sf):
    return exploded(pl.gray_vector(cells(spark, sf), G))


SEM = ("severity", "fail", "high", "stby", "valid", "wafer")


@query("a19_semantic_vector", flat_sql([("maps", c) for c in SEM]), ("maps",))
def _(spark, sf):
    return exploded(pl.semantic_vector(cells(spark, sf), G))


@query("s23_tensor_dataset", "SELECT t.id, round(v,9) AS total, sig AS signature FROM (SELECT id, sum(v) v FROM (" + flat_sql(TENSOR) + ") GROUP BY 1) t JOIN (SELECT sample_id AS id, ("
       + SIG + ")::BIGINT AS sig FROM labels25) s ON s.id=t.id ORDER BY t.id LIMIT 10", ("pool", "labels25"))
def _(spark, sf):
    t = pl.input_tensor(cells(spark, sf), G).join(wafer_signatures(spark, sf), "id").orderBy("id").limit(10)
    return t.select("id", F.round(F.aggregate("vec", F.lit(0.0), lambda acc, v: acc + v), 9).alias("total"), "signature")


@query("p34_grid_edges", "SELECT 24 AS height, 24 AS width, i::INT AS i, (i*24//7)::INT AS y_edge, (i*24//7)::INT AS x_edge FROM (SELECT unnest(range(8)) AS i) WHERE EXISTS (SELECT 1 FROM px)", ("px",))
def _(spark, sf):
    return pl.grid_edges(demo.pixels(spark, sf), 7)


@query("p34_pixel_cells", "SELECT sample_id, y, x, (SELECT max(i) FROM range(7) t(i) WHERE i*24//7<=y)::INT AS gy FROM px WHERE in_wafer=1", ("px",))
def _(spark, sf):
    return demo.pixels(spark, sf).filter("in_wafer = 1").select("sample_id", "y", "x", pl.grid_cell(F.col("y"), F.col("height"), 7).alias("gy"))


# ---- score maps and windows
def score_sql(cls):
    if cls == "local":
        s = "0.45*high+0.35*severity+0.25*fail+0.25*stby"
    elif cls == "stby_pattern":
        s = "stby+0.20*high+0.10*severity"
    elif cls == "shot_grid":
        s = "0.55*fail+0.35*severity+0.20*high"
    else:
        s = "0.45*severity+0.35*fail+0.35*high+0.35*stby"
        if cls == "edge":
            s = f'({s})*(0.35+"outer")'
    return f"({s})*wafer"


part("cscore", " UNION ALL ".join(f"SELECT sample_id, '{c}' AS class_name, gy, gx, wafer, {score_sql(c)} AS score FROM maps" for c in C.REPORT_CLASSES), ("maps",))
part("wmean", f"""SELECT a.sample_id, a.class_name, a.gy, a.gx, sum(b.score)/9.0::DOUBLE AS mean FROM cscore a JOIN cscore b ON b.sample_id=a.sample_id AND b.class_name=a.class_name
   AND b.gy-a.gy BETWEEN 0 AND 2 AND b.gx-a.gx BETWEEN 0 AND 2 WHERE a.gy<=9 AND a.gx<=9 GROUP BY 1,2,3,4""", ("cscore",))
IOU = "(greatest(0,3-abs({a}.gy-{b}.gy))*greatest(0,3-abs({a}.gx-{b}.gx)))"
NOVER = "{o}::DOUBLE/(18-{o}) <= 0.2"
BEST = "row_number() OVER (PARTITION BY c.sample_id, c.class_name ORDER BY round(c.mean,9) DESC, c.gy, c.gx) AS k"
part("w1", f"SELECT * FROM (SELECT c.*, {BEST} FROM wmean c) WHERE k=1", ("wmean",))
_o1 = NOVER.format(o=IOU.format(a="c", b="p"))
_o2 = NOVER.format(o=IOU.format(a="c", b="q"))
part("w2", f"SELECT * FROM (SELECT c.*, {BEST} FROM wmean c JOIN w1 p ON p.sample_id=c.sample_id AND p.class_name=c.class_name WHERE {_o1}) WHERE k=1", ("wmean", "w1"))
part("w3", f"SELECT * FROM (SELECT c.*, {BEST} FROM wmean c JOIN w1 p ON p.sample_id=c.sample_id AND p.class_name=c.class_name JOIN w2 q ON q.sample_id=c.sample_id AND q.class_name=c.class_name WHERE {_o1} AND {_o2}) WHERE k=1", ("wmean", "w1", "w2"))
part("wins", "SELECT sample_id, class_name, 1 AS place, gy, gx, mean FROM w1 UNION ALL SELECT sample_id, class_name, 2, gy, gx, mean FROM w2 UNION ALL SELECT sample_id, class_name, 3, gy, gx, mean FROM w3", ("w1", "w2", "w3"))


def scores(spark, sf):
    return pr.score_rows(maps(spark, sf), C.REPORT_CLASSES)


def windows(spark, sf):
    def build():
        means = pr.window_means(scores(spark, sf), "score", W, G, ["sample_id", "class_name"])
        return pr.suppress_windows(means, W, 3)
    return staged_once(spark, sf, "windows", build)


@query("p29_class_scores", "SELECT sample_id, class_name, gy, gx, round(score,9) AS score FROM cscore", ("cscore",))
def _(spark, sf):
    return scores(spark, sf).select("sample_id", "class_name", "gy", "gx", F.round("score", 9).alias("score"))


@query("p29_curve_scores", """SELECT sample_id, class_name, gy, gx, round(score,9) AS score FROM (SELECT sample_id, 'ring' AS class_name, gy, gx, (0.35*severity+0.30*severity_peak+0.25*fail+0.15*high)*wafer AS score FROM maps
   UNION ALL SELECT sample_id, 'scratch', gy, gx, (0.25*severity+0.45*severity_peak+0.25*fail+0.15*high+0.10*stby)*wafer FROM maps)""", ("maps",))
def _(spark, sf):
    return pr.score_rows(maps(spark, sf), ("ring", "scratch"), pr.curve_score).select(
        "sample_id", "class_name", "gy", "gx", F.round("score", 9).alias("score"))


@query("a21_window_means", "SELECT sample_id, class_name, gy, gx, round(mean,9) AS mean FROM wmean", ("wmean",))
def _(spark, sf):
    m = pr.window_means(scores(spark, sf), "score", W, G, ["sample_id", "class_name"])
    return m.withColumn("mean", F.round("mean", 9))


@query("j09_suppressed_windows", "SELECT sample_id, class_name, place, gy, gx, round(mean,9) AS mean FROM wins", ("wins",))
def _(spark, sf):
    return windows(spark, sf).withColumn("mean", F.round("mean", 9))


BOX = "SELECT sample_id, class_name, place, gy, gx, gy*2 AS y0, (gy+3)*2 AS y1, gx*2 AS x0, (gx+3)*2 AS x1 FROM wins"


def boxes(spark, sf):
    return pr.window_boxes(windows(spark, sf), W, G, F.lit(24), F.lit(24))


@query("p35_window_boxes", BOX, ("wins",))
def _(spark, sf):
    return boxes(spark, sf).drop("mean")


@query("p35_box_text_round_trip", f"SELECT sample_id, class_name, y0, y1, x0, x1 FROM ({BOX})", ("wins",))
def _(spark, sf):
    packed = boxes(spark, sf).groupBy("sample_id", "class_name").agg(
        F.collect_list(F.struct("y0", "y1", "x0", "x1", F.col("mean").alias("score"))).alias("b"))
    back = pr.parse_boxes(pr.boxes_text(F.col("b")))
    return packed.select("sample_id", "class_name", F.explode(back).alias("b")).select("sample_id", "class_name", "b.y0", "b.y1", "b.x0", "b.x1")


part("tpx", " UNION ALL ".join(f"SELECT sample_id, '{c}' AS class_name, y, x FROM px WHERE {c}>0" for c in C.REPORT_CLASSES), ("px",))
part("wrec", f"""SELECT sample_id, class_name, count(*) AS target_pixels, avg(hit) AS proposal_recall FROM (SELECT t.sample_id, t.class_name, t.y, t.x, max((b.y0 IS NOT NULL)::INT) AS hit
   FROM tpx t LEFT JOIN ({BOX}) b ON b.sample_id=t.sample_id AND b.class_name=t.class_name AND t.y>=b.y0 AND t.y<b.y1 AND t.x>=b.x0 AND t.x<b.x1 GROUP BY 1,2,3,4) GROUP BY 1,2""", ("tpx", "wins"))


@query("a24_window_recall", "SELECT * FROM wrec", ("wrec",))
def _(spark, sf):
    return pr.window_recall(pr.grid_targets(demo.pixels(spark, sf), C.REPORT_CLASSES, G), windows(spark, sf), W, "proposal_recall")


def random_found(spark, sf):
    m = pr.window_means(scores(spark, sf), "wafer", W, G, ["sample_id", "class_name"])
    return pr.random_windows(m, 3, 23)


@query("a23_random_windows")
def _(spark, sf):
    return random_found(spark, sf)


@query("a24_recall_summary")
def _(spark, sf):
    targets = pr.grid_targets(demo.pixels(spark, sf), C.REPORT_CLASSES, G)
    p = pr.window_recall(targets, windows(spark, sf), W, "proposal_recall")
    q = pr.window_recall(targets, random_found(spark, sf), W, "random_recall").drop("target_pixels")
    return pr.recall_summary(p.join(q, ["sample_id", "class_name"]), (0.1, 0.3))


@query("u04_covered_pixels", f"SELECT sample_id, class_name, count(*) AS covered FROM (SELECT DISTINCT t.sample_id, t.class_name, t.y, t.x FROM tpx t JOIN ({BOX}) b ON b.sample_id=t.sample_id AND b.class_name=t.class_name "
       "AND t.y>=b.y0 AND t.y<b.y1 AND t.x>=b.x0 AND t.x<b.x1) GROUP BY 1,2", ("tpx", "wins"))
def _(spark, sf):
    rec = pr.window_recall(pr.grid_targets(demo.pixels(spark, sf), C.REPORT_CLASSES, G), windows(spark, sf), W)
    return rec.select("sample_id", "class_name", F.round(F.col("recall") * F.col("target_pixels")).cast("long").alias("covered")).filter("covered > 0")


# ---- polar proposals
def psc(cls):
    sev = "least(greatest(severity,0),7)/7.0::DOUBLE"
    f, h = "(severity>=1)::INT::DOUBLE", "(severity>=6)::INT::DOUBLE"
    s = f"0.50*{sev}+0.35*{f}+0.15*{h}" if cls == "ring" else f"0.45*{sev}+0.30*{f}+0.15*{h}+0.25*(stby>0)::INT::DOUBLE"
    return f"({s})*in_wafer"


RB = f"least(floor(least(radius,0.999999)*{R}),{R - 1})::INT"
AB = f"least(floor(least(theta,0.999999)*{A}),{A - 1})::INT"
part("psx", " UNION ALL ".join(f"SELECT sample_id, '{c}' AS class_name, y, x, {RB} AS r, {AB} AS a, {psc(c)} AS score FROM pol WHERE in_wafer=1" for c in ("ring", "scratch")), ("pol",))
part("pbin", "SELECT sample_id, class_name, r, a, avg(score) AS score FROM psx GROUP BY 1,2,3,4", ("psx",))
part("pgrid", f"SELECT k.sample_id, k.class_name, r.v AS r, a.v AS a, coalesce(p.score,0.0) AS score FROM (SELECT DISTINCT sample_id, class_name FROM pbin) k CROSS JOIN (SELECT unnest(range({R}))::INT v) r CROSS JOIN (SELECT unnest(range({A}))::INT v) a "
     "LEFT JOIN pbin p ON p.sample_id=k.sample_id AND p.class_name=k.class_name AND p.r=r.v AND p.a=a.v", ("pbin",))
TOPR = max(2, int(R * 0.90))
part("arcs", f"""SELECT 'ring' AS class_name, 'annulus' AS kind, r0, r0+rw AS r1, 0 AS a0, {A} AS a1 FROM (SELECT unnest(range(1,4))::INT rw) w, (SELECT unnest(range(1,{R}))::INT r0) z WHERE r0<least({R}-rw,{TOPR})
 UNION ALL SELECT 'ring','partial_ring', r0, r0+rw, a0, a0+aw FROM (SELECT unnest(range(1,4))::INT rw) w, (SELECT unnest(range(1,{R}))::INT r0) z, (SELECT unnest([8,12,16,24])::INT aw) q, (SELECT unnest(range(0,{A},2))::INT a0) y WHERE r0<least({R}-rw,{TOPR})
 UNION ALL SELECT 'scratch','spin_arc', r0, r0+rw, a0, a0+aw FROM (SELECT unnest(range(1,4))::INT rw) w, (SELECT unnest(range(1,{R}))::INT r0) z, (SELECT unnest([4,8,12,16])::INT aw) q, (SELECT unnest(range(0,{A},2))::INT a0) y WHERE r0<{R}-rw
 UNION ALL SELECT 'scratch','radial_scratch', r0, r1, a0, a0+aw FROM (SELECT unnest(range(1,{max(2, R // 2)}))::INT r0) z, (SELECT unnest(range(0,{R}))::INT r1) v, (SELECT unnest([1,2,3])::INT aw) q, (SELECT unnest(range(0,{A}))::INT a0) y WHERE r1>=greatest(r0+{R // 3},{R // 2})""")
part("pbase", "SELECT sample_id, class_name, median(score) base, greatest(0.01, 0.2*stddev_pop(score)) thr FROM pgrid WHERE score>0 GROUP BY 1,2", ("pgrid",))
part("arcscore", f"""SELECT sample_id, class_name, kind, r0, r1, a0, a1, CASE WHEN np=0 THEN tot/n ELSE ps/np*(0.15+CASE WHEN kind='radial_scratch' THEN nr::DOUBLE/(r1-r0) ELSE nc::DOUBLE/(a1-a0) END)*sqrt(greatest(np::DOUBLE/n,1.0::DOUBLE/n)) END AS score
 FROM (SELECT g.sample_id, c.class_name, c.kind, c.r0, c.r1, c.a0, c.a1, (c.r1-c.r0)*(c.a1-c.a0) AS n, sum(score-base) tot, sum((score-base>thr)::INT) np, sum(CASE WHEN score-base>thr THEN score-base ELSE 0 END) ps,
    count(DISTINCT CASE WHEN score-base>thr THEN o END) nc, count(DISTINCT CASE WHEN score-base>thr THEN r END) nr
   FROM arcs c JOIN LATERAL (SELECT unnest(range(c.a0,c.a1))::INT AS o) s ON true JOIN pgrid g ON g.class_name=c.class_name AND g.r>=c.r0 AND g.r<c.r1 AND g.a=s.o%{A}
   JOIN pbase b ON b.sample_id=g.sample_id AND b.class_name=g.class_name GROUP BY ALL)""", ("arcs", "pgrid", "pbase"))


def polar_score_rows(spark, sf):
    return pr.polar_scores(polar(spark, sf), ("ring", "scratch"), R, A)


def arcs_found(spark, sf):
    return staged_once(spark, sf, "arcs", lambda: pr.arc_candidates(polar_score_rows(spark, sf), R, A, 3))


@query("p28_pixel_scores", "SELECT sample_id, class_name, y, x, round(score,9) AS score FROM psx", ("psx",))
def _(spark, sf):
    rows = F.array(*[F.struct(F.lit(c).alias("class_name"), pr.pixel_score(c).alias("score")) for c in ("ring", "scratch")])
    return demo.pixels(spark, sf).filter("in_wafer = 1").select("sample_id", "y", "x", F.explode(rows).alias("s")).select(
        "sample_id", "s.class_name", "y", "x", F.round("s.score", 9).alias("score"))


@query("a20_polar_scores", "SELECT sample_id, class_name, r, a, round(score,9) AS score FROM pbin", ("pbin",))
def _(spark, sf):
    return polar_score_rows(spark, sf).withColumn("score", F.round("score", 9))


part("ptar", " UNION ALL ".join(f"SELECT sample_id, '{c}' AS class_name, {RB} AS r, {AB} AS a, count(*) AS n FROM pol WHERE {c}>0 GROUP BY 1,2,3,4" for c in ("ring", "scratch")), ("pol",))


@query("a20_polar_targets", "SELECT * FROM ptar", ("ptar",))
def _(spark, sf):
    return pr.polar_targets(polar(spark, sf), ("ring", "scratch"), R, A)


@query("a20_grid_targets", "SELECT sample_id, class_name, (((y+1)*12-1)//24)::INT AS gy, (((x+1)*12-1)//24)::INT AS gx, count(*) AS n FROM tpx GROUP BY 1,2,3,4", ("tpx",))
def _(spark, sf):
    return pr.grid_targets(demo.pixels(spark, sf), C.REPORT_CLASSES, G)


@query("a22_arc_scores", "SELECT sample_id, class_name, kind, r0, r1, a0, a1, floor(score*1e6+0.3137)::BIGINT AS score_millionths FROM arcscore", ("arcscore",))
def _(spark, sf):
    return pr.arc_candidates(polar_score_rows(spark, sf), R, A).withColumn(
        "score_millionths", F.floor(F.col("score") * 1e6 + 0.3137)).drop("place", "score")


part("arcord", f"""SELECT *, (SELECT sum(1::BIGINT << ((a0+o)%{A})) FROM range(0, a1-a0) t(o))::BIGINT AS bins, CASE WHEN kind IN ('annulus','spin_arc') THEN 0 ELSE 1 END AS o0, CASE WHEN kind='radial_scratch' THEN r0 ELSE r1-r0 END AS o1,
   CASE WHEN kind='radial_scratch' THEN r1 ELSE a1-a0 END AS o2, CASE WHEN kind='radial_scratch' THEN a1-a0 ELSE r0 END AS o3 FROM arcscore""", ("arcscore",))
_ORD = "row_number() OVER (PARTITION BY c.sample_id, c.class_name ORDER BY round(c.score,9) DESC, c.o0, c.o1, c.o2, c.o3, c.a0) AS k"


def _apart(p):
    inter = f"(greatest(0, least(c.r1,{p}.r1)-greatest(c.r0,{p}.r0))*bit_count(c.bins & {p}.bins))"
    return f"{inter}::DOUBLE/greatest(1, (c.r1-c.r0)*(c.a1-c.a0)+({p}.r1-{p}.r0)*({p}.a1-{p}.a0)-{inter}) <= 0.35"


def _same(p):
    return f"JOIN {p} ON {p}.sample_id=c.sample_id AND {p}.class_name=c.class_name"


part("arc1", f"SELECT * FROM (SELECT c.*, {_ORD} FROM arcord c) WHERE k=1", ("arcord",))
part("arc2", f"SELECT * FROM (SELECT c.*, {_ORD} FROM arcord c {_same('arc1')} WHERE {_apart('arc1')}) WHERE k=1", ("arcord", "arc1"))
part("arc3", f"SELECT * FROM (SELECT c.*, {_ORD} FROM arcord c {_same('arc1')} {_same('arc2')} WHERE {_apart('arc1')} AND {_apart('arc2')}) WHERE k=1", ("arcord", "arc1", "arc2"))


@query("j10_suppressed_arcs", " UNION ALL ".join(f"SELECT sample_id, class_name, {i} AS place, kind, r0, r1, a0, a1, floor(score*1e6+0.3137)::BIGINT AS score_millionths FROM arc{i}" for i in (1, 2, 3)), ("arc1", "arc2", "arc3"))
def _(spark, sf):
    return arcs_found(spark, sf).withColumn("score_millionths", F.floor(F.col("score") * 1e6 + 0.3137)).drop("score")


@query("p30_circular_bins", f"SELECT sample_id, class_name, r, a, ((a-20)%{A}+{A})%{A} < 10 AS inside FROM pbin", ("pbin",))
def _(spark, sf):
    return polar_score_rows(spark, sf).select(
        "sample_id", "class_name", "r", "a", fc.circular_member(F.col("a"), F.lit(20), F.lit(10), A).alias("inside"))


@query("a23_random_arcs")
def _(spark, sf):
    groups = polar_score_rows(spark, sf).select("sample_id", "class_name").distinct()
    return pr.random_arcs(groups, R, A, 3, 29)


@query("a24_arc_recall_summary")
def _(spark, sf):
    targets = pr.polar_targets(polar(spark, sf), ("ring", "scratch"), R, A)
    p = pr.arc_recall(targets, arcs_found(spark, sf), A, "proposal_recall")
    q = pr.arc_recall(targets, pr.random_arcs(targets.select("sample_id", "class_name").distinct(), R, A, 3, 29), A, "random_recall")
    return pr.recall_summary(p.join(q.drop("target_pixels"), ["sample_id", "class_name"]), (0.3, 0.5))


# one fixed arc per class stands for the candidates, so that coverage can be stated in SQL
def fixed_arcs(spark, sf):
    groups = polar_score_rows(spark, sf).select("sample_id", "class_name").distinct()
    ring = F.col("class_name") == "ring"
    return groups.select("sample_id", "class_name", F.when(ring, 4).otherwise(2).alias("r0"), F.when(ring, 6).otherwise(7).alias("r1"),
                         F.when(ring, 18).otherwise(5).alias("a0"), F.when(ring, 34).otherwise(11).alias("a1"))


INARC = f"CASE WHEN class_name='ring' THEN r>=4 AND r<6 AND ((a-18)%{A}+{A})%{A}<16 ELSE r>=2 AND r<7 AND ((a-5)%{A}+{A})%{A}<6 END"


@query("a24_arc_recall", f"SELECT sample_id, class_name, sum(n)::BIGINT AS target_pixels, sum(CASE WHEN {INARC} THEN n ELSE 0 END)::DOUBLE/sum(n) AS recall FROM ptar GROUP BY 1,2", ("ptar",))
def _(spark, sf):
    return pr.arc_recall(pr.polar_targets(polar(spark, sf), ("ring", "scratch"), R, A), fixed_arcs(spark, sf), A)


part("gpol", f"""SELECT sample_id, gy, gx, least(floor(least(least(d/greatest(far,1.0),0.999),0.999999)*{R}),{R - 1})::INT AS r,
   least(floor(least(fmod(atan2(gx-5.5,-(gy-5.5))+2*pi(),2*pi())/(2*pi()),0.999999)*{A}),{A - 1})::INT AS a
   FROM (SELECT *, max(d) OVER (PARTITION BY sample_id) far FROM (SELECT sample_id, gy, gx, sqrt((gy-5.5)*(gy-5.5)+(gx-5.5)*(gx-5.5)) d FROM maps WHERE wafer>0.2))""", ("maps",))


@query("p36_arcs_on_grid", f"SELECT sample_id, class_name, gy, gx FROM gpol, (VALUES ('ring'),('scratch')) c(class_name) WHERE {INARC}", ("gpol",))
def _(spark, sf):
    return pr.arcs_on_grid(maps(spark, sf), fixed_arcs(spark, sf), G, R, A)


# ---- representations compared
SIZES = (32, 64)
for _n in SIZES:
    part(f"pool{_n}", f"""SELECT sample_id AS id, ((y+1)*{_n}-1)//24 AS gy, ((x+1)*{_n}-1)//24 AS gx, sum(CASE WHEN stby=1 THEN 7 WHEN in_wafer=1 THEN severity ELSE 0 END)::DOUBLE/(7.0::DOUBLE*count(*)) AS gray,
       sum(valid*severity)::DOUBLE/greatest(1,sum(valid))/7.0::DOUBLE AS severity, sum((valid=1 AND severity>0)::INT)::DOUBLE/greatest(1,sum(valid)) AS fail, sum((valid=1 AND severity>=6)::INT)::DOUBLE/greatest(1,sum(valid)) AS high,
       sum(in_wafer*stby)::DOUBLE/greatest(1,sum(in_wafer)) AS stby, sum(in_wafer*valid)::DOUBLE/greatest(1,sum(in_wafer)) AS valid, sum(in_wafer)::DOUBLE/count(*) AS wafer FROM px GROUP BY 1,2,3""", ("px",))
_spaces = " UNION ALL ".join(
    [f"SELECT 'naive_gray_{n}' AS space, id, gy*1000+gx AS feature, gray AS v FROM pool{n}" for n in SIZES]
    + [f"SELECT 'semantic_pool_{n}', id, {i}*1000000+gy*1000+gx, {c} FROM pool{n}" for n in SIZES for i, c in enumerate(SEM)])
part("repz", f"""SELECT space, id, feature::VARCHAR AS feature, (v-avg(v) OVER w)/greatest(stddev_pop(v) OVER w,1e-6) AS z FROM ({_spaces}) WINDOW w AS (PARTITION BY space, feature)
   UNION ALL SELECT 'compact_features', id, feature, z FROM zc""", (*[f"pool{n}" for n in SIZES], "zc"))
part("repnn", space_nn_sql("repz", K), ("repz",))


def representation_neighbors(spark, sf):
    def build():
        compact = search.standardised(wafer_features(spark, sf), COMPACT).select(F.lit("compact_features").alias("space"), "id", "vec")
        both = search.standardised_vectors(pl.representations(demo.pixels(spark, sf), SIZES)).select("space", "id", "vec").unionByName(compact)
        return search.nearest(both, both, K, exclude_same_id=True)
    return staged_once(spark, sf, "representations", build)


@query("r08_representations", f"""SELECT space, round(avg(j),9) AS mean_neighbor_label_jaccard, round((SELECT m FROM chance),9) AS random_pair_label_jaccard, round(avg(j)/greatest((SELECT m FROM chance),1e-9),9) AS lift
   FROM (SELECT n.space, {jac('a.sig', 'b.sig')} AS j FROM repnn n JOIN sigs a ON a.id=n.query_id JOIN sigs b ON b.id=n.neighbor_id) GROUP BY 1""", ("repnn", "sigs", "chance"))
def _(spark, sf):
    return rounded9(rt.label_lift(representation_neighbors(spark, sf), wafer_signatures(spark, sf), by=("space",)))


# ---- statistics
LAB = [f"label_{c}" for c in C.REPORT_CLASSES]
part("fval", f"SELECT u.feature, round(u.v,9) AS v, {', '.join('l.' + n for n in LAB)} FROM (UNPIVOT (SELECT sample_id, {', '.join(COMPACT)} FROM f_compact) ON {', '.join(COMPACT)} INTO NAME feature VALUE v) u "
     "JOIN labels25 l ON l.sample_id=u.sample_id", ("f_compact", "labels25"))
part("fauc", " UNION ALL ".join(f"SELECT feature, '{n}' AS class_name, sum({n})::BIGINT AS positives, sum(1-{n})::BIGINT AS negatives, CASE WHEN sum({n})*sum(1-{n})=0 THEN 0.5 ELSE (sum(CASE WHEN {n}=1 THEN mr END)-sum({n})*(sum({n})+1)/2.0::DOUBLE)"
                                f"/(sum({n})*sum(1-{n})) END AS auc FROM fmr GROUP BY 1" for n in LAB), ("fmr",))
part("fmr", "SELECT *, rank() OVER (PARTITION BY feature ORDER BY v)+(count(*) OVER (PARTITION BY feature, v)-1)/2.0::DOUBLE AS mr FROM fval", ("fval",))
part("fsep", " UNION ALL ".join(f"""SELECT feature, '{n}' AS class_name, CASE WHEN n0<2 OR n1<2 THEN 0.0 ELSE (n0*(m0-g)**2+n1*(m1-g)**2)/greatest((n0*s0+n1*s1)/greatest(n0+n1-2,1),1e-9) END AS discriminability_score FROM (
   SELECT feature, avg(v) g, sum({n}) n1, sum(1-{n}) n0, avg(CASE WHEN {n}=1 THEN v END) m1, avg(CASE WHEN {n}=0 THEN v END) m0, var_pop(CASE WHEN {n}=1 THEN v END) s1, var_pop(CASE WHEN {n}=0 THEN v END) s0 FROM fval GROUP BY 1)""" for n in LAB), ("fval",))


def feature_values(spark, sf):
    f = wafer_features(spark, sf).select(*COMPACT, *LAB)
    return f.unpivot(LAB, COMPACT, "feature", "v").withColumn("v", F.round("v", 9))


@query("a36_roc_auc", "SELECT feature, class_name, positives, negatives, round(auc,9) AS auc FROM fauc", ("fauc",))
def _(spark, sf):
    return rounded9(st.class_auc(feature_values(spark, sf), tuple(LAB)))


@query("a35_separation_score", "SELECT feature, class_name, round(discriminability_score,4) AS discriminability_score FROM fsep", ("fsep",))
def _(spark, sf):
    return st.separation_score(feature_values(spark, sf), tuple(LAB)).withColumn("discriminability_score", F.round("discriminability_score", 4))


@query("a36_top_features", """SELECT feature, class_name, round(auc,6) AS auc, direction, place FROM (SELECT *, row_number() OVER (PARTITION BY class_name ORDER BY round(auc,9) DESC, round(discriminability_score,6) DESC, feature) AS place FROM (
   SELECT a.feature, a.class_name, greatest(auc,1-auc) auc, CASE WHEN auc>=0.5 THEN 'high' ELSE 'low' END AS direction, discriminability_score FROM fauc a JOIN fsep s ON s.feature=a.feature AND s.class_name=a.class_name
   WHERE positives>=2 AND negatives>=2)) WHERE place<=8""", ("fauc", "fsep"))
def _(spark, sf):
    return st.top_features(feature_values(spark, sf), tuple(LAB)).select("feature", "class_name", F.round("auc", 6).alias("auc"), "direction", "place")


@query("a36_event_auc", """SELECT 'value' AS feature, t AS class_name, p AS positives, n AS negatives, round(auc,9) AS auc FROM (SELECT t, sum(y)::BIGINT p, sum(1-y)::BIGINT n, (sum(CASE WHEN y=1 THEN mr END)-sum(y)*(sum(y)+1)/2.0::DOUBLE)/(sum(y)*sum(1-y)) AS auc
   FROM (SELECT e.event_type, k.t, (e.event_type=k.t)::INT::BIGINT AS y, mr FROM (SELECT event_type, rank() OVER (ORDER BY value)+(count(*) OVER (PARTITION BY value)-1)/2.0::DOUBLE AS mr FROM events) e, (SELECT DISTINCT event_type AS t FROM events) k) GROUP BY 1)""")
def _(spark, sf):
    v = demo.table(spark, sf, "events").select(F.lit("value").alias("feature"), F.col("value").alias("v"), "event_type")
    return rounded9(st.group_auc(v, "event_type"))


@query("w06_mid_ranks", "SELECT l_returnflag, v, count(*) AS n, min(r)+(count(*)-1)/2.0::DOUBLE AS mid_rank FROM (SELECT l_returnflag, l_quantity::DOUBLE AS v, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) AS r FROM lineitem) GROUP BY 1,2")
def _(spark, sf):
    v = demo.table(spark, sf, "lineitem").select("l_returnflag", F.col("l_quantity").cast("double").alias("v"))
    return st.mid_ranks(v, ["l_returnflag"])


@query("w11_exact_quantiles", "SELECT event_type, round(median(value),6) AS median, round(quantile_cont(value,0.95),6) AS p95 FROM events GROUP BY 1")
def _(spark, sf):
    q = ordering.exact_quantiles(demo.table(spark, sf, "events"), ["event_type"], "value", {"median": 0.5, "p95": 0.95})
    return rounded(q, keep=())


@query("w12_row_index", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey)-1 AS idx FROM orders")
def _(spark, sf):
    return ordering.row_index(demo.table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"])


# probabilities that follow from the wafer number, one per class
PROB = "((w*37+{i}*11)%100)/100.0::DOUBLE"
part("preds", " UNION ALL ".join(f"SELECT l.sample_id, '{c}' AS class_name, label_{c} AS truth, {PROB.format(i=i)} AS p FROM labels25 l JOIN (SELECT DISTINCT sample_id, w FROM px) k ON k.sample_id=l.sample_id"
                                 for i, c in enumerate(C.REPORT_CLASSES)), ("labels25", "px"))


def predictions(spark, sf):
    w = F.substring("sample_id", 2, 9).cast("long")
    rows = F.array(*[F.struct(F.lit(c).alias("class_name"), F.col(f"label_{c}").alias("truth"), ((w * 37 + i * 11) % 100 / 100.0).alias("p"))
                     for i, c in enumerate(C.REPORT_CLASSES)])
    return wafer_features(spark, sf).select("sample_id", F.explode(rows).alias("r")).select("sample_id", "r.*")


@query("a33_confusion", """SELECT class_name, sum(truth)::BIGINT AS positives, sum(q)::BIGINT AS predicted, coalesce(sum(truth*q)::DOUBLE/nullif(sum(q),0),0.0) AS precision, coalesce(sum(truth*q)::DOUBLE/nullif(sum(truth),0),0.0) AS recall,
   coalesce(sum(truth*q)::DOUBLE/nullif(sum(greatest(truth,q)),0),0.0) AS iou FROM (SELECT *, (p>=0.5)::INT AS q FROM preds) GROUP BY 1""", ("preds",))
def _(spark, sf):
    return st.confusion(predictions(spark, sf).withColumn("pred", (F.col("p") >= 0.5).cast("int")))


@query("a33_pixel_iou", " UNION ALL ".join(f"SELECT '{c}' AS class_name, sum({c})::BIGINT AS positives, sum(q)::BIGINT AS predicted, sum({c}*q)::DOUBLE/sum(q) AS precision, coalesce(sum({c}*q)::DOUBLE/nullif(sum({c}),0),0.0) AS recall, "
                                           f"sum({c}*q)::DOUBLE/sum(greatest({c},q)) AS iou FROM (SELECT *, (severity>=3)::INT AS q FROM px)" for c in C.REPORT_CLASSES), ("px",))
def _(spark, sf):
    rows = F.array(*[F.struct(F.lit(c).alias("class_name"), F.col(c).alias("truth")) for c in C.REPORT_CLASSES])
    return st.confusion(demo.pixels(spark, sf).select((F.col("severity") >= 3).cast("int").alias("pred"), F.explode(rows).alias("r")).select("pred", "r.*"))


CE = "-({w}truth*ln(p+1e-6)+(1-truth)*ln(1-p+1e-6))"


@query("a34_cross_entropy", f"""SELECT class_name, round(avg({CE.format(w='')}),6) AS bce, round(avg({CE.format(w='pw*')}),6) AS weighted_bce FROM (SELECT *, least((1-pv)/pv,50.0) AS pw FROM (
   SELECT *, least(greatest(avg(truth) OVER (PARTITION BY class_name),1e-6),1.0) AS pv FROM preds)) GROUP BY 1""", ("preds",))
def _(spark, sf):
    rows = predictions(spark, sf)
    prevalence = rows.groupBy("class_name").agg(F.avg("truth").alias("pv"))
    y, p = F.col("truth").cast("double"), F.col("p")
    return rounded(rows.join(prevalence, "class_name").groupBy("class_name").agg(
        F.avg(st.cross_entropy(y, p)).alias("bce"), F.avg(st.cross_entropy(y, p, st.positive_weight(F.col("pv")))).alias("weighted_bce")))


@query("p23_score_uncertainty", """SELECT sample_id, round(avg(-(q*ln(q)+(1-q)*ln(1-q))),6) AS mean_binary_entropy, round(max(p)-max(p) FILTER (k=2),6) AS confidence_margin, max_by(class_name, (p, -ci)) AS top_label, max(p) AS top_probability
   FROM (SELECT *, least(greatest(p,1e-6),1-1e-6) AS q, row_number() OVER (PARTITION BY sample_id ORDER BY p DESC) AS k, list_position(['scratch','ring','edge','local','shot_grid','stby_pattern'], class_name) AS ci FROM preds) GROUP BY 1""".replace("max(p)-max(p) FILTER (k=2)", "max(p)-max(CASE WHEN k=2 THEN p END)"), ("preds",))
def _(spark, sf):
    return _uncertain(spark, sf).select("sample_id", F.round("mean_binary_entropy", 6).alias("mean_binary_entropy"),
                                        F.round("confidence_margin", 6).alias("confidence_margin"), "top_label", "top_probability")


def _uncertain(spark, sf):
    w = F.substring("sample_id", 2, 9).cast("long")
    probs = F.array(*[((w * 37 + i * 11) % 100 / 100.0) for i in range(len(C.REPORT_CLASSES))])
    return wafer_features(spark, sf).select("sample_id", probs.alias("probs")).withColumns(st.score_uncertainty(F.col("probs"), C.REPORT_CLASSES))


@query("p24_review_priority", """SELECT sample_id, CASE WHEN e>=0.60 OR round(m,9)<0.10 THEN 'review_high_uncertain' WHEN t>=0.75 THEN 'review_high_strong_synthetic_match' ELSE 'review_medium' END AS review_priority FROM (
   SELECT sample_id, avg(-(q*ln(q)+(1-q)*ln(1-q))) e, max(p)-max(CASE WHEN k=2 THEN p END) m, max(p) t FROM (SELECT *, least(greatest(p,1e-6),1-1e-6) AS q, row_number() OVER (PARTITION BY sample_id ORDER BY p DESC) AS k FROM preds) GROUP BY 1)""", ("preds",))
def _(spark, sf):
    return _uncertain(spark, sf).select("sample_id", "review_priority")


@query("v14_readiness", """SELECT 'no positives: '||class_name AS issue FROM (SELECT class_name, sum(truth) n FROM preds GROUP BY 1 UNION ALL SELECT 'random', 0 WHERE EXISTS (SELECT 1 FROM preds)) WHERE n=0
   UNION ALL SELECT 'few validation samples' FROM (SELECT count(DISTINCT sample_id) n FROM preds WHERE substr(sample_id,2)::BIGINT%4=0) WHERE n<10""", ("preds",))
def _(spark, sf):
    rows = predictions(spark, sf).unionByName(wafer_features(spark, sf).select("sample_id", F.lit("random").alias("class_name"), F.col("label_random").alias("truth"), F.lit(0.5).alias("p")))
    per = rows.groupBy("class_name").agg(F.sum("truth").alias("positives"))
    loss = rows.agg(F.avg(st.cross_entropy(F.col("truth").cast("double"), F.col("p"))).alias("bce"))
    val = wafer_features(spark, sf).select("sample_id").filter(F.substring("sample_id", 2, 9).cast("long") % 4 == 0)
    return st.readiness_issues(val, per, loss)


CHECKS = [("lift_above_1_10", "lift", ">=", 1.10), ("lift_above_1_25", "lift", ">=", 1.25), ("chance_below_one", "random_pair_label_jaccard", "<=", 1.0)]


@query("v13_acceptance", f"""SELECT c.n AS check_name, c.m AS metric, round(v.value,9) AS value, c.b::DOUBLE AS bound, CASE c.op WHEN '>=' THEN v.value>=c.b ELSE v.value<=c.b END AS passed FROM (VALUES {', '.join(f"('{n}','{m}','{op}',{b})" for n, m, op, b in CHECKS)}) c(n,m,op,b)
   JOIN (SELECT 'lift' AS metric, j/greatest(m,1e-9) AS value FROM (SELECT avg(jaccard) j FROM nnj), chance UNION ALL SELECT 'random_pair_label_jaccard', m FROM chance) v ON v.metric=c.m""", ("nnj", "chance"))
def _(spark, sf):
    from siliscope.plans.search_queries import wafer_neighbors
    lift = rt.label_lift(wafer_neighbors(spark, sf), wafer_signatures(spark, sf))
    narrow = lift.unpivot([], ["lift", "random_pair_label_jaccard"], "metric", "value")
    return rounded9(va.acceptance(narrow, spark.createDataFrame(CHECKS, "check_name string, metric string, op string, bound double")))


@query("p32_lift_strength", "SELECT feature, class_name, CASE WHEN auc>=1.35 THEN 'strong' WHEN auc>=1.10 THEN 'moderate' ELSE 'weak' END AS strength FROM (SELECT feature, class_name, round(auc*2,9) AS auc FROM fauc)", ("fauc",))
def _(spark, sf):
    from siliscope.operators.review import strength
    return st.class_auc(feature_values(spark, sf), tuple(LAB)).select("feature", "class_name", strength(F.round(F.col("auc") * 2, 9)).alias("strength"))


@query("a37_mask_detection", """SELECT round(coalesce(avg(CASE WHEN e>0 THEN b::DOUBLE/e END),1.0),9) AS mean_iou, round(coalesce(avg(CASE WHEN t>0 THEN b::DOUBLE/t END),1.0),9) AS mean_recall, round(coalesce(avg(CASE WHEN p>0 THEN b::DOUBLE/p END),1.0),9) AS mean_precision
  FROM (SELECT sample_id, sum(stby*q) b, sum(greatest(stby,q)) e, sum(stby) t, sum(q) p FROM (SELECT *, (severity=0 AND in_wafer=1 AND h%2=0)::INT AS q FROM px) GROUP BY 1)""", ("px",))
def _(spark, sf):
    px = demo.pixels(spark, sf).withColumn("guess", ((F.col("severity") == 0) & (F.col("in_wafer") == 1) & (F.col("h") % 2 == 0)).cast("int"))
    return rounded9(st.mask_detection(px, "stby", "guess"))


# ---- lots: eight wafers each, two-pixel blocks, hot from grade six
part("lotpx", "SELECT *, (w//8)::BIGINT AS lot8 FROM px", ("px",))
part("hsobs", "SELECT lot8 AS lot_id, cy, cx, count(*) AS observed FROM (SELECT DISTINCT lot8, sample_id, y//2 AS cy, x//2 AS cx FROM lotpx WHERE severity>=6) GROUP BY 1,2,3", ("lotpx",))
part("hscell", """SELECT o.lot_id, o.cy, o.cx, observed, n_lot, base AS baseline_rate, observed::DOUBLE/n_lot AS observed_rate, observed::DOUBLE/n_lot/base AS lift,
   (observed-n_lot*base)/sqrt(n_lot*base*(1-base)+1e-4) AS z_score, (SELECT sum(exp(lgamma(n_lot+1)-lgamma(j+1)-lgamma(n_lot-j+1)+j*ln(base)+(n_lot-j)*ln(1-base))) FROM range(observed, n_lot+1) t(j)) AS p_value
  FROM (SELECT o.*, n_lot, least(greatest(CASE WHEN tot-n_lot>0 THEN (alln-observed)::DOUBLE/(tot-n_lot) ELSE 0.0 END,1e-4),0.99) AS base FROM hsobs o JOIN (SELECT lot8, count(DISTINCT sample_id) AS n_lot FROM lotpx GROUP BY 1) s ON s.lot8=o.lot_id
    JOIN (SELECT cy, cx, sum(observed) alln FROM hsobs GROUP BY 1,2) e ON e.cy=o.cy AND e.cx=o.cx, (SELECT count(DISTINCT sample_id) tot FROM lotpx)) o""", ("hsobs", "lotpx"))
part("hsq", """SELECT *, least(1.0, min(p_value*144/k) OVER (PARTITION BY lot_id ORDER BY k DESC ROWS UNBOUNDED PRECEDING)) AS q_value FROM (SELECT *, row_number() OVER (PARTITION BY lot_id ORDER BY round(p_value,12), cy, cx) AS k FROM hscell)""", ("hscell",))


def lot_cells(spark, sf):
    px = demo.pixels(spark, sf).withColumn("lot_id", F.floor(F.col("w") / 8).cast("long"))
    return hs.hotspot_cells(px, 24, 24, block=2, hot_grade=6)


@query("a40_lot_cells", "SELECT lot_id, cy, cx, observed, n_lot, round(baseline_rate,9) AS baseline_rate, round(lift,6) AS lift, round(z_score,6) AS z_score, round(p_value,9) AS p_value FROM hscell", ("hscell",))
def _(spark, sf):
    return lot_cells(spark, sf).select("lot_id", "cy", "cx", "observed", "n_lot", F.round("baseline_rate", 9).alias("baseline_rate"),
                                       F.round("lift", 6).alias("lift"), F.round("z_score", 6).alias("z_score"), F.round("p_value", 9).alias("p_value"))


@query("a41_q_values", "SELECT lot_id, cy, cx, round(q_value,9) AS q_value FROM hsq", ("hsq",))
def _(spark, sf):
    return lot_cells(spark, sf).select("lot_id", "cy", "cx", F.round("q_value", 9).alias("q_value"))


@query("a40_repeating_hotspots", """SELECT lot_id, cy, cx, observed, round(q_value,9) AS q_value, (cx*2+1)::INT AS x_pixel, (cy*2+1)::INT AS y_pixel, round(sqrt((cx*2+1-12)**2+(cy*2+1-12)**2),6) AS radius_pixel, round(degrees(atan2(cy*2+1-12, cx*2+1-12)),6) AS theta_deg
   FROM hsq WHERE observed>=greatest(5,floor(n_lot*0.25)) AND round(lift,9)>=3.0 AND round(q_value,9)<=0.05 ORDER BY round(q_value,12), round(lift,9) DESC, observed_rate DESC, lot_id, cy, cx LIMIT 20""", ("hsq",))
def _(spark, sf):
    found = hs.repeating_hotspots(lot_cells(spark, sf), 24, 24, 2, min_count=5, min_lift=3.0, max_q=0.05)
    return found.select("lot_id", "cy", "cx", "observed", F.round("q_value", 9).alias("q_value"), "x_pixel", "y_pixel",
                        F.round("radius_pixel", 6).alias("radius_pixel"), F.round("theta_deg", 6).alias("theta_deg"))


@query("a40_loose_hotspots", """SELECT lot_id, cy, cx, observed, round(q_value,9) AS q_value, (cx*2+1)::INT AS x_pixel, (cy*2+1)::INT AS y_pixel, round(sqrt((cx*2+1-12)**2+(cy*2+1-12)**2),6) AS radius_pixel, round(degrees(atan2(cy*2+1-12, cx*2+1-12)),6) AS theta_deg
   FROM hsq WHERE observed>=greatest(3,floor(n_lot*0.25)) AND round(lift,9)>=1.5 AND round(q_value,9)<=0.9 ORDER BY round(q_value,12), round(lift,9) DESC, observed_rate DESC, lot_id, cy, cx LIMIT 20""", ("hsq",))
def _(spark, sf):
    found = hs.repeating_hotspots(lot_cells(spark, sf), 24, 24, 2, min_count=3, min_lift=1.5, max_q=0.9)
    return found.select("lot_id", "cy", "cx", "observed", F.round("q_value", 9).alias("q_value"), "x_pixel", "y_pixel",
                        F.round("radius_pixel", 6).alias("radius_pixel"), F.round("theta_deg", 6).alias("theta_deg"))


@query("a40_hotspots_with_exclusion", "SELECT lot8 AS lot_id, cy, cx, count(*) AS observed FROM (SELECT DISTINCT lot8, sample_id, y//2 AS cy, x//2 AS cx FROM lotpx WHERE severity>=6 AND local=0) GROUP BY 1,2,3", ("lotpx",))
def _(spark, sf):
    px = demo.pixels(spark, sf).withColumn("lot_id", F.floor(F.col("w") / 8).cast("long"))
    return hs.hotspot_cells(px, 24, 24, block=2, hot_grade=6, exclude="local").select("lot_id", "cy", "cx", "observed")


# ---- rotation-invariant spectrum and local density
@query("a38_angular_spectrum", """SELECT sample_id, k::INT AS k, round(m/(max(CASE WHEN k=0 THEN m END) OVER (PARTITION BY sample_id)+1e-6),6) AS magnitude FROM (
   SELECT sample_id, k, sqrt(power(sum(m*cos(2*pi()*k*bin/24.0::DOUBLE)),2)+power(sum(m*sin(2*pi()*k*bin/24.0::DOUBLE)),2)) AS m FROM prof_theta, range(0,13) t(k) GROUP BY 1,2) QUALIFY k>0""", ("prof_theta",))
def _(spark, sf):
    p = ft.bin_profile(polar(spark, sf), "theta", 24)
    return pl.angular_spectrum(p, 24).select("sample_id", "k", F.round("magnitude", 6).alias("magnitude"))


@query("a38_local_density", """SELECT c.sample_id, c.gy, c.gx, round(sum(b.v)/25.0::DOUBLE,9) AS box_mean FROM (SELECT sample_id, y AS gy, x AS gx FROM px) c, range(-2,3) dy(d), range(-2,3) dx(d),
   (SELECT sample_id, y, x, (severity>=3 AND valid=1)::INT AS v FROM px) b WHERE b.sample_id=c.sample_id AND b.y=CASE WHEN c.gy+dy.d<0 THEN -(c.gy+dy.d)-1 WHEN c.gy+dy.d>23 THEN 47-(c.gy+dy.d) ELSE c.gy+dy.d END
   AND b.x=CASE WHEN c.gx+dx.d<0 THEN -(c.gx+dx.d)-1 WHEN c.gx+dx.d>23 THEN 47-(c.gx+dx.d) ELSE c.gx+dx.d END GROUP BY 1,2,3""", ("px",))
def _(spark, sf):
    px = demo.pixels(spark, sf).select("sample_id", F.col("y").alias("gy"), F.col("x").alias("gx"), ((F.col("severity") >= 3) & (F.col("valid") == 1)).cast("int").alias("v"))
    return pl.box_mean(px, "v", 2, 24, 24, ["sample_id"]).withColumn("box_mean", F.round("box_mean", 9))
