"""Defect-region, class-balance and batch-report queries with their check SQL."""
from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from siliscope import constants as C
from siliscope.functions import columns as fc
from siliscope.functions import names as nm
from siliscope.operators import features as ft
from siliscope.operators import geometry as gm
from siliscope.operators import regions as rg
from siliscope.operators import retrieval as rt
from siliscope.operators import search
from siliscope.plans import demo
from siliscope.plans.feature_queries import COMPACT, GEO, POLAR, polar
from siliscope.plans.registry import part, query
from siliscope.plans.search_queries import K, rounded9, shared_pixels, space_nn_sql, staged_once, wafer_features, z_sql

HOUR = "lpad((CASE WHEN {h}=0 THEN 12 ELSE {h} END)::VARCHAR,2,'0')||':00'"
TURN = "fmod(atan2({dx},-({dy}))+2*pi(),2*pi())/(2*pi())"
PMOD = "fmod(fmod(atan2({dx},-({dy})),2*pi())+2*pi(),2*pi())/(2*pi())"


def clock_sql(dx, dy):
    h = f"round_even({PMOD.format(dx=dx, dy=dy)}*12,0)::INT"
    return f"CASE WHEN ({dx})=0 AND ({dy})=0 THEN 'center' ELSE {HOUR.format(h='(' + h + ')')} END"


SECTOR = f"(round_even({TURN.format(dx='(x-11.5)', dy='(y-11.5)')}*12,0)::INT % 12)"

part("cpx", " UNION ALL ".join(
    f"SELECT sample_id, '{c}' AS class_name, x, y, d2, stby, {SECTOR} AS sector FROM px WHERE in_wafer=1 AND {c}>0"
    for c in C.REPORT_CLASSES), ("px",))
part("reg0", """SELECT g.*, n::DOUBLE/nw AS pixel_ratio, sd/n/greatest(sqrt(ext::DOUBLE),2.0) AS radius, sx/(2.0::DOUBLE*n) AS dx, sy/(2.0::DOUBLE*n) AS dy
  FROM (SELECT sample_id, class_name, count(*) n, sum(stby) ns, sum(2*x-23) sx, sum(2*y-23) sy, sum(sqrt(d2::DOUBLE)) sd FROM cpx GROUP BY 1,2) g
  JOIN (SELECT sample_id, sum(in_wafer) nw, max(wafer_extent) ext FROM px GROUP BY 1) w ON w.sample_id=g.sample_id""", ("cpx", "px"))
part("regsec", """SELECT *, row_number() OVER (PARTITION BY sample_id, class_name ORDER BY n DESC, sector DESC) k FROM (
  SELECT sample_id, class_name, sector, count(*) n FROM cpx GROUP BY 1,2,3)""", ("cpx",))
part("regions26", f"""SELECT sample_id, class_name, pixel_ratio, centroid_clock, radial_zone, location_label, top_clock_positions, top_sector_share,
   stby_overlap_ratio, class_name||'__'||lower(replace(replace(location_label,':',''),' ','_'))||'__'||lower(replace(radial_zone,'-','_')) AS feature_key,
   row_number() OVER (PARTITION BY sample_id ORDER BY CASE class_name WHEN 'scratch' THEN 0 WHEN 'local' THEN 1 WHEN 'edge' THEN 2 WHEN 'ring' THEN 3
     WHEN 'shot_grid' THEN 4 ELSE 5 END) AS position
 FROM (SELECT *, CASE WHEN class_name='ring' AND top_sector_share<0.20 THEN 'ring_global'
    WHEN class_name='edge' AND radius>=0.72 AND top_sector_share<0.24 THEN 'edge_global'
    WHEN class_name='shot_grid' AND top_sector_share<0.22 THEN 'wafer_global' WHEN top_sector_share<0.16 THEN 'wafer_global'
    ELSE coalesce(top1, centroid_clock) END AS location_label,
    CASE WHEN radius<0.33 THEN 'center' WHEN radius<0.72 THEN 'middle' ELSE 'edge-side' END AS radial_zone
  FROM (SELECT r.*, {clock_sql('dx', 'dy')} AS centroid_clock, t.top_clock_positions, t.top1, t.n1::DOUBLE/r.n AS top_sector_share,
      CASE WHEN r.class_name='stby_pattern' THEN 1.0 ELSE ns::DOUBLE/r.n END AS stby_overlap_ratio
    FROM reg0 r JOIN (SELECT sample_id, class_name, string_agg({HOUR.format(h='sector')}, '|' ORDER BY k) AS top_clock_positions,
       max(CASE WHEN k=1 THEN {HOUR.format(h='sector')} END) top1, max(CASE WHEN k=1 THEN n END) n1 FROM regsec WHERE k<=3 GROUP BY 1,2) t
      ON t.sample_id=r.sample_id AND t.class_name=r.class_name WHERE r.pixel_ratio>=1e-5))""", ("reg0", "regsec"))


def region_table(spark, sf):
    return staged_once(spark, sf, "regions", lambda: rg.region_rows(shared_pixels(spark, sf)))


@query("p07_clock_position", f"SELECT sample_id, y, x, {clock_sql('(x-11.5)', '(y-11.5)')} AS clock FROM px WHERE in_wafer=1", ("px",))
def _(spark, sf):
    return demo.pixels(spark, sf).filter("in_wafer = 1").select(
        "sample_id", "y", "x", fc.clock_position(gm.pixel_dx(), gm.pixel_dy()).alias("clock"))


@query("p08_sector", f"SELECT sample_id, y, x, {SECTOR} AS sector, {HOUR.format(h=SECTOR)} AS clock FROM px WHERE in_wafer=1", ("px",))
def _(spark, sf):
    s = fc.sector12(gm.pixel_dx(), gm.pixel_dy())
    return demo.pixels(spark, sf).filter("in_wafer = 1").select("sample_id", "y", "x", s.alias("sector"),
                                                                fc.hour_label(s).alias("clock"))


@query("p09_radial_zone", """SELECT sample_id, CASE WHEN radius<0.33 THEN 'center' WHEN radius<0.72 THEN 'middle' ELSE 'edge-side' END AS zone,
  count(*) AS pixels FROM pol WHERE in_wafer=1 GROUP BY 1,2""", ("pol",))
def _(spark, sf):
    return (polar(spark, sf).filter("in_wafer = 1").groupBy("sample_id", fc.radial_zone(F.col("radius")).alias("zone"))
            .agg(F.count(F.lit(1)).alias("pixels")))


@query("p10_location_label", "SELECT sample_id, class_name, location_label FROM regions26", ("regions26",))
def _(spark, sf):
    return region_table(spark, sf).select("sample_id", "class_name", "location_label")


@query("p11_feature_key", "SELECT sample_id, class_name, feature_key FROM regions26", ("regions26",))
def _(spark, sf):
    return region_table(spark, sf).select("sample_id", "class_name", "feature_key")


part("tkeys", """SELECT sample_id, class_name, 'class' AS target_kind, class_name AS target_id FROM regions26 UNION ALL
 SELECT sample_id, class_name, 'class_radial', class_name||'__'||radial_zone FROM regions26 UNION ALL
 SELECT sample_id, class_name, 'class_location', class_name||'__'||location_label FROM regions26 UNION ALL
 SELECT sample_id, class_name, 'feature_key', feature_key FROM regions26""", ("regions26",))
part("targets4", """SELECT target_kind, target_id, count(DISTINCT sample_id) AS support, min(class_name) AS class_name FROM tkeys GROUP BY 1,2
 HAVING count(DISTINCT sample_id)>=2 AND count(DISTINCT sample_id) < (SELECT count(DISTINCT sample_id) FROM px)""", ("tkeys", "px"))


@query("p12_target_keys", "SELECT * FROM tkeys", ("tkeys",))
def _(spark, sf):
    return rt.target_rows(region_table(spark, sf))


@query("r04_targets", "SELECT * FROM targets4", ("targets4",))
def _(spark, sf):
    return rt.targets(region_table(spark, sf), wafer_features(spark, sf), 2)


ALL = COMPACT + POLAR
SPACES = {f"{c}|{s}": nm.class_columns(ALL, c, "class_location" if s == "location" else "class")
          for c in C.REPORT_CLASSES for s in ("plain", "location")}
part("zall", z_sql("f_all", ALL), ("f_all",))
part("spz", " UNION ALL ".join(f"SELECT '{s}' AS space, * FROM zall WHERE feature IN ({', '.join(repr(n) for n in ns)})"
                               for s, ns in SPACES.items()), ("zall",))
part("spnn", space_nn_sql("spz", K), ("spz",))
part("tnn", """SELECT t.target_kind, t.target_id, t.class_name, n.query_id, n.rank, n.neighbor_id, n.distance,
   (h.sample_id IS NOT NULL)::INT AS neighbor_has_target
 FROM targets4 t JOIN (SELECT DISTINCT target_kind, target_id, sample_id FROM tkeys) q ON q.target_kind=t.target_kind AND q.target_id=t.target_id
 JOIN spnn n ON n.query_id=q.sample_id AND n.space=t.class_name||'|'||CASE WHEN t.target_kind IN ('class_location','feature_key') THEN 'location' ELSE 'plain' END
 LEFT JOIN (SELECT DISTINCT target_kind, target_id, sample_id FROM tkeys) h ON h.target_kind=t.target_kind AND h.target_id=t.target_id AND h.sample_id=n.neighbor_id""",
     ("targets4", "tkeys", "spnn"))
part("tmet", """SELECT m.target_kind, m.target_id, t.class_name, t.support, (t.support-1)::DOUBLE/greatest(n-1,1) AS random_precision, p AS precision_at_k,
   p/greatest((t.support-1)::DOUBLE/greatest(n-1,1),1e-9) AS lift, h AS hit_rate_at_k, rr AS mrr
 FROM (SELECT target_kind, target_id, avg(p) p, avg(h) h, avg(rr) rr FROM (SELECT target_kind, target_id, query_id, avg(neighbor_has_target) p,
     max(neighbor_has_target) h, coalesce(1.0::DOUBLE/min(CASE WHEN neighbor_has_target=1 THEN rank END),0.0) rr FROM tnn GROUP BY 1,2,3) GROUP BY 1,2) m
 JOIN targets4 t ON t.target_kind=m.target_kind AND t.target_id=m.target_id, (SELECT count(DISTINCT sample_id) n FROM px)""", ("tnn", "targets4", "px"))


def target_found(spark, sf):
    """Neighbour rows of every target: one search per class with and without location-aware columns."""
    def build():
        nn = search.neighbors_in_spaces(wafer_features(spark, sf), SPACES, K)
        regions = region_table(spark, sf)
        return rt.target_neighbor_rows(regions, rt.targets(regions, wafer_features(spark, sf), 2), nn)
    return staged_once(spark, sf, "target_neighbors", build)


def target_quality(spark, sf):
    feats = wafer_features(spark, sf)
    return rt.target_metrics(target_found(spark, sf), rt.targets(region_table(spark, sf), feats, 2), feats)


@query("j06_target_neighbors", "SELECT * EXCLUDE (distance), round(distance,6) AS distance FROM tnn", ("tnn",))
def _(spark, sf):
    return target_found(spark, sf).withColumn("distance", F.round("distance", 6))


@query("r03_target_metrics", """SELECT target_kind, target_id, class_name, support, round(random_precision,9) AS random_precision,
  round(precision_at_k,9) AS precision_at_k, round(lift,9) AS lift, round(hit_rate_at_k,9) AS hit_rate_at_k, round(mrr,9) AS mrr FROM tmet""", ("tmet",))
def _(spark, sf):
    return rounded9(target_quality(spark, sf))


@query("r05_kind_summary", """SELECT k.k AS target_kind, count(t.target_id) AS target_count,
   round(coalesce(sum(lift*support)/sum(support),0.0),9) AS mean_lift, round(coalesce(sum(precision_at_k*support)/sum(support),0.0),9) AS mean_precision_at_k,
   round(coalesce(sum(hit_rate_at_k*support)/sum(support),0.0),9) AS mean_hit_rate_at_k
   FROM (VALUES ('class'),('class_radial'),('class_location'),('feature_key')) k(k) LEFT JOIN tmet t ON t.target_kind=k.k GROUP BY 1""", ("tmet",))
def _(spark, sf):
    return rounded9(rt.kind_summary(target_quality(spark, sf)))


@query("a26_defect_regions", """SELECT sample_id, class_name, feature_key, pixel_ratio, centroid_clock, location_label, radial_zone, top_clock_positions,
  top_sector_share, stby_overlap_ratio, position FROM regions26""", ("regions26",))
def _(spark, sf):
    r = rg.in_report_order(rg.region_rows(demo.pixels(spark, sf))).drop("radius")
    return r.withColumn("top_clock_positions", F.array_join("top_clock_positions", "|"))


@query("a27_region_metrics", """SELECT class_name, count(DISTINCT sample_id) AS sample_count, round(avg(pixel_ratio),9) AS mean_pixel_ratio,
   round(avg(stby_overlap_ratio),9) AS mean_stby_overlap, round(quantile_cont(stby_overlap_ratio,0.95),9) AS p95_stby_overlap,
   count(DISTINCT sample_id)::DOUBLE/(SELECT count(DISTINCT sample_id) FROM px) AS presence_rate FROM regions26 GROUP BY 1""", ("regions26", "px"))
def _(spark, sf):
    total = wafer_features(spark, sf).agg(F.count(F.lit(1))).scalar()
    return rounded9(rg.region_metrics(region_table(spark, sf), total))


part("cratio", " UNION ALL ".join(f"SELECT sample_id, '{c}' AS class_name, sum(in_wafer*{c})::DOUBLE/greatest(1,sum(in_wafer)) AS ratio FROM px GROUP BY 1"
                                  for c in C.PATTERN_CLASSES), ("px",))


@query("a28_class_balance", """SELECT class_name, sum((ratio>0)::INT)::BIGINT AS positive_samples, avg((ratio>0)::INT) AS sample_presence_rate, round(avg(ratio),9) AS mean_pixel_ratio,
   round(coalesce(quantile_cont(ratio,0.5) FILTER (ratio>0),0.0),9) AS median_positive_ratio, round(coalesce(quantile_cont(ratio,0.95) FILTER (ratio>0),0.0),9) AS p95_positive_ratio,
   round(least((1-avg(ratio))/greatest(avg(ratio),1e-9),50.0),6) AS suggested_pos_weight_capped FROM cratio GROUP BY 1""", ("cratio",))
def _(spark, sf):
    b = rg.class_balance(rg.class_ratio_rows(demo.pixels(spark, sf)))
    return rounded9(b).withColumn("suggested_pos_weight_capped", F.round("suggested_pos_weight_capped", 6))


PAIRS = list(combinations(C.PATTERN_CLASSES, 2))


@query("a29_class_pair_overlap", "SELECT pair, avg(co) AS cooccurrence_rate, round(avg(o),9) AS mean_overlap_pixel_ratio FROM (" + " UNION ALL ".join(
    f"SELECT sample_id, '{a}+{b}' AS pair, max(in_wafer*{a})*max(in_wafer*{b}) AS co, sum(CASE WHEN y%2=0 AND x%2=0 THEN in_wafer*{a}*{b} ELSE 0 END)::DOUBLE"
    f"/greatest(1,sum(CASE WHEN y%2=0 AND x%2=0 THEN in_wafer ELSE 0 END)) AS o FROM px GROUP BY 1" for a, b in PAIRS) + ") GROUP BY 1", ("px",))
def _(spark, sf):
    return rounded9(rg.pair_overlap(rg.class_combinations(demo.pixels(spark, sf), C.PATTERN_CLASSES, 2), C.PATTERN_CLASSES))


@query("a30_scratch_risk", """SELECT count(*) AS scratch_positive_samples, round(avg(ring),9) AS scratch_ring_cooccurrence_rate, round(avg(local),9) AS scratch_local_cooccurrence_rate,
   round(avg(stby),9) AS scratch_stby_cooccurrence_rate, round(avg(h),9) AS scratch_pixels_hidden_by_stby_mean, round(quantile_cont(h,0.95),9) AS scratch_pixels_hidden_by_stby_p95
 FROM (SELECT sample_id, max(in_wafer*ring) ring, max(in_wafer*local) local, max(in_wafer*stby) stby, sum(in_wafer*scratch*stby)::DOUBLE/sum(in_wafer*scratch) h
   FROM px GROUP BY 1 HAVING sum(in_wafer*scratch)>0)""", ("px",))
def _(spark, sf):
    return rounded9(rg.scratch_risk(demo.pixels(spark, sf)))


@query("a31_grade_histogram", "SELECT sample_id, " + ", ".join(f"sum((valid=1 AND severity={g})::INT)::BIGINT AS grade_{g}" for g in range(8))
       + " FROM px GROUP BY 1", ("px",))
def _(spark, sf):
    return rg.grade_histogram(demo.pixels(spark, sf))


part("realism", """SELECT sample_id, sum((valid=1 AND severity=0)::INT)::DOUBLE/greatest(1,sum(valid)) AS grade0_ratio,
  coalesce(sum(CASE WHEN c THEN severity END),0)::DOUBLE/greatest(1,sum(c::INT)) AS center_mean_grade, coalesce(sum(CASE WHEN e THEN severity END),0)::DOUBLE/greatest(1,sum(e::INT)) AS edge_mean_grade,
  sum((c AND severity>0)::INT)::DOUBLE/greatest(1,sum(c::INT)) AS center_fail_density, sum((e AND severity>0)::INT)::DOUBLE/greatest(1,sum(e::INT)) AS edge_fail_density,
  sum(stby)::BIGINT AS stby_pixels, sum(stby)::DOUBLE/16 AS stby_chips_est
 FROM (SELECT *, valid=1 AND sqrt(d2::DOUBLE)/sqrt(wafer_extent::DOUBLE)<0.55 AS c, valid=1 AND sqrt(d2::DOUBLE)/sqrt(wafer_extent::DOUBLE)>0.78 AS e FROM px) GROUP BY 1""", ("px",))


@query("a31_sample_realism", "SELECT * FROM realism", ("realism",))
def _(spark, sf):
    return rg.sample_realism(demo.pixels(spark, sf), F.lit(16.0))


part("facesall", """SELECT i.sample_id, coalesce(o-n,0.0) AS face_difference FROM (SELECT DISTINCT sample_id FROM px) i LEFT JOIN (
  SELECT sample_id, sum((face>0.66 AND severity>0)::INT)::DOUBLE/greatest(1,sum((face>0.66)::INT)) o, sum((face<0.34 AND severity>0)::INT)::DOUBLE/greatest(1,sum((face<0.34)::INT)) n
  FROM (SELECT *, (radius-rmin)/(rmax-rmin) face FROM (SELECT *, min(radius) OVER w rmin, max(radius) OVER w rmax, max(CASE WHEN valid=1 THEN radius END) OVER w vmax
     FROM pol WINDOW w AS (PARTITION BY sample_id,chip_row,chip_col)) WHERE vmax>=0.78 AND rmax>rmin AND valid=1) GROUP BY 1) f ON f.sample_id=i.sample_id""", ("px", "pol"))


@query("a05_edge_face_all_pixels", "SELECT sample_id, face_difference AS edge_chip_outer_minus_inner_density FROM facesall", ("facesall",))
def _(spark, sf):
    return ft.edge_face_density(polar(spark, sf), GEO, face_of="all")


@query("a31_batch_realism", """SELECT count(*) AS sample_count, round(avg(grade0_ratio),9) AS grade0_ratio_mean, round(min(grade0_ratio),9) AS grade0_ratio_min, round(max(grade0_ratio),9) AS grade0_ratio_max,
  round(avg(edge_fail_density-center_fail_density),9) AS edge_minus_center_fail_density_mean, sum((edge_fail_density-center_fail_density>0)::INT)::BIGINT AS edge_higher_count,
  round(avg(face_difference),9) AS face_difference_mean, sum((face_difference>0)::INT)::BIGINT AS face_higher_count, min(grade0_ratio)>0 AS grade0_present_all_samples,
  sum((edge_fail_density-center_fail_density>0)::INT)>=ceil(count(*)*0.6) AS edge_higher_majority, sum((face_difference>0)::INT)>=ceil(count(*)*0.6) AS face_higher_majority,
  min(stby_pixels)>0 AS stby_present_all_samples FROM realism r JOIN facesall f ON f.sample_id=r.sample_id""", ("realism", "facesall"))
def _(spark, sf):
    px = polar(spark, sf)
    faces = ft.edge_face_density(px, GEO, face_of="all").withColumnRenamed("edge_chip_outer_minus_inner_density", "face_difference")
    return rounded9(rg.batch_realism(rg.sample_realism(px, F.lit(16.0)).join(faces, "sample_id")))


# pattern metadata of a wafer: one entry per class it carries; the parameters follow from its number
part("pats", """SELECT sample_id, w, 'local' AS type, ['single_blob','double_blob','triple_triangle'][w%3+1] AS mode, NULL::VARCHAR AS seeded, NULL::VARCHAR AS latent, NULL::VARCHAR AS anchor FROM wl WHERE local=1
 UNION ALL SELECT sample_id, w, 'scratch', CASE WHEN w%2=0 THEN 'spin_arc' END, NULL, NULL, NULL FROM wl WHERE scratch=1
 UNION ALL SELECT sample_id, w, 'stby_pattern', CASE WHEN w%3=0 THEN 'origin_coupled' WHEN w%3=1 THEN 'latent_weighted' END, CASE WHEN w%5>0 THEN (w%2)::VARCHAR END, (w%3)::VARCHAR, NULL FROM wl WHERE stby=1
 UNION ALL SELECT sample_id, w, 'shot_grid', NULL, NULL, NULL, CASE WHEN w%3>0 THEN 'lower_left' END FROM wl WHERE shot_grid=1""", ("wl",))
part("wl", "SELECT sample_id, max(w) w, max(local) local, max(scratch) scratch, max(stby) stby, max(shot_grid) shot_grid FROM px GROUP BY 1", ("px",))


def pattern_table(spark, sf):
    w = F.col("w")
    flags = demo.pixels(spark, sf).groupBy("sample_id").agg(
        F.max("w").alias("w"), *[F.max(c).alias(c) for c in ("local", "scratch", "stby", "shot_grid")])

    def entry(ptype, flag_col, **params):
        keys = [(k, v.cast("string")) for k, v in params.items()]
        entries = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in keys]), lambda e: e["v"].isNotNull())
        return F.when(F.col(flag_col) == 1, F.struct(F.lit(ptype).alias("type"), F.map_from_entries(entries).alias("parameters")))

    modes = F.array(F.lit("single_blob"), F.lit("double_blob"), F.lit("triple_triangle"))
    return flags.select("sample_id", F.array_compact(F.array(
        entry("local", "local", mode=F.element_at(modes, (w % 3 + 1).cast("int"))),
        entry("scratch", "scratch", mode=F.when(w % 2 == 0, "spin_arc")),
        entry("stby_pattern", "stby", mode=F.when(w % 3 == 0, "origin_coupled").when(w % 3 == 1, "latent_weighted"),
              seeded_stby_chip_count=F.when(w % 5 > 0, w % 2), latent_weighted_stby_chip_count_est=w % 3),
        entry("shot_grid", "shot_grid", anchor_region=F.when(w % 3 > 0, "lower_left")))).alias("patterns"))


@query("a31_pattern_modes", "SELECT type, mode, count(*) AS n FROM pats GROUP BY 1,2", ("pats",))
def _(spark, sf):
    return rg.pattern_modes(pattern_table(spark, sf))


@query("p31_pattern_labels", """SELECT sample_id, CASE type WHEN 'stby_pattern' THEN CASE WHEN seeded IS NULL AND starts_with(coalesce(mode,''),'origin_coupled') THEN 'stby:origin-unverified'
    WHEN coalesce(seeded::INT,0)>0 AND coalesce(latent::INT,0)>0 THEN 'stby:origin+latent' WHEN coalesce(seeded::INT,0)>0 THEN 'stby:origin'
    WHEN coalesce(latent::INT,0)>0 OR starts_with(coalesce(mode,''),'latent_weighted') THEN 'stby:latent' ELSE 'stby' END
   WHEN 'local' THEN CASE mode WHEN 'single_blob' THEN 'local:single' WHEN 'double_blob' THEN 'local:double' WHEN 'triple_triangle' THEN 'local:tri' ELSE 'local' END
   WHEN 'shot_grid' THEN CASE WHEN anchor IS NULL THEN 'shot' ELSE 'shot:'||replace(anchor,'lower_left','LL') END
   ELSE CASE WHEN type IN ('scratch','ring') AND mode IS NOT NULL THEN type||':'||mode ELSE type END END AS label FROM pats""", ("pats",))
def _(spark, sf):
    p = pattern_table(spark, sf).select("sample_id", F.explode("patterns").alias("p"))
    return p.select("sample_id", rg.pattern_label(F.col("p.type"), F.col("p.parameters")).alias("label"))


LBL = ", ".join(f"CASE WHEN label_{c}=1 THEN '{c}' END" for c in C.REPORT_CLASSES)


@query("p31_active_labels", f"SELECT sample_id, coalesce(nullif(concat_ws(', ', {LBL}),''),'background') AS labels FROM labels25", ("labels25",))
def _(spark, sf):
    return ft.class_labels(demo.pixels(spark, sf), C.REPORT_CLASSES).select(
        "sample_id", rg.active_labels({c: F.col(f"label_{c}") for c in C.REPORT_CLASSES}).alias("labels"))


SPLIT = "CASE WHEN ('0x'||substr(sha256('{seed}:'||{id}),1,12))::UBIGINT::DOUBLE/(16.0::DOUBLE**12) < {f} THEN 'val' ELSE 'train' END"


@query("p22_stable_split", f"SELECT o_orderkey, {SPLIT.format(seed=7, id='o_orderkey::VARCHAR', f=0.2)} AS split FROM orders")
def _(spark, sf):
    return demo.table(spark, sf, "orders").select("o_orderkey", rg.stable_split(F.col("o_orderkey").cast("string"), 0.2, 7).alias("split"))


MR = ", ".join(f"sum(in_wafer*{c})::DOUBLE/greatest(1,sum(in_wafer)) AS {c}_mask_ratio, (sum(in_wafer*{c})>0)::INT AS has_{c}" for c in C.PATTERN_CLASSES)


@query("s22_segmentation_manifest", f"SELECT *, {' + '.join('has_' + c for c in C.PATTERN_CLASSES)} AS active_target_count, "
       f"{SPLIT.format(seed=11, id='sample_id', f=0.25)} AS split FROM (SELECT sample_id, {MR} FROM px GROUP BY 1)", ("px",))
def _(spark, sf):
    return rg.segmentation_manifest(demo.pixels(spark, sf), 0.25, 11)


@query("v12_supported_regions", "SELECT class_name, count(*) AS regions FROM regions26 WHERE pixel_ratio>=1e-5 GROUP BY 1 HAVING count(*)>=3", ("regions26",))
def _(spark, sf):
    r = rg.region_rows(demo.pixels(spark, sf), min_ratio=1e-5)
    return r.groupBy("class_name").agg(F.count(F.lit(1)).alias("regions")).filter("regions >= 3")



@query("v12_large_supported_regions", "SELECT class_name, count(*) AS regions FROM regions26 WHERE pixel_ratio>=0.02 GROUP BY 1 HAVING count(*)>=3", ("regions26",))
def _(spark, sf):
    r = rg.region_rows(demo.pixels(spark, sf), min_ratio=0.02)
    return r.groupBy("class_name").agg(F.count(F.lit(1)).alias("regions")).filter("regions >= 3")


@query("r15_best_class_wafers", """SELECT class_name, max_by(sample_id, (ratio, -w)) AS sample_id FROM (SELECT c.*, p.w FROM cratio c
   JOIN (SELECT DISTINCT sample_id, w FROM px) p ON p.sample_id=c.sample_id) WHERE ratio>0 GROUP BY 1""", ("cratio", "px"))
def _(spark, sf):
    r = rg.class_ratio_rows(demo.pixels(spark, sf)).filter("ratio > 0")
    return r.groupBy("class_name").agg(F.min_by("sample_id", F.struct(-F.col("ratio"), F.col("sample_id"))).alias("sample_id"))


