"""Wafer feature queries and their check SQL."""
from __future__ import annotations

from pyspark.sql import functions as F

from siliscope import constants as C
from siliscope.functions import columns as fc
from siliscope.operators import components as cmp
from siliscope.operators import features as ft
from siliscope.operators import geometry as gm
from siliscope.plans import demo
from siliscope.plans.registry import part, query

GEO = gm.Geometry(**demo.GEOMETRY)


def rounded(df, keep=("sample_id",), digits=6):
    """Rounded view of every double column."""
    return df.select(*[F.round(F.col(c), digits).alias(c) if t == "double" and c not in keep else F.col(c)
                       for c, t in df.dtypes])


def polar(spark, sf):
    return gm.with_polar(demo.pixels(spark, sf))


def chip_table(spark, sf):
    return gm.by_wafer(gm.chips(demo.pixels(spark, sf), GEO))


# ---- check SQL shared by the feature queries
RZ = [f"radial_zone_{i:02d}_severity" for i in range(5)]
AS = [f"angular_sector_{i:02d}_severity" for i in range(12)]


def zone_sql(pos, bins, names):
    return ", ".join(
        f"coalesce(sum(CASE WHEN valid=1 AND least(floor(least({pos},0.999999)*{bins}), {bins - 1})={i} "
        f"THEN severity END),0)::DOUBLE / (7.0::DOUBLE * greatest(1, sum(CASE WHEN valid=1 AND "
        f"least(floor(least({pos},0.999999)*{bins}), {bins - 1})={i} THEN 1 ELSE 0 END))) AS {n}"
        for i, n in enumerate(names))


def frate(z):
    b = f"valid=1 AND least(floor(least(radius,0.999999)*5),4)={z}"
    return (f"(sum(CASE WHEN {b} AND severity>0 THEN 1 ELSE 0 END)::DOUBLE"
            f" / greatest(1, sum(CASE WHEN {b} THEN 1 ELSE 0 END)))")


part("f_global", """SELECT sample_id,
  sum(CASE WHEN valid=1 AND severity>0 THEN 1 ELSE 0 END)::DOUBLE / greatest(1, sum(valid)) AS total_fail_density,
  sum(CASE WHEN valid=1 THEN severity ELSE 0 END)::DOUBLE / (7.0::DOUBLE*greatest(1, sum(valid))) AS grade_weighted_severity,
  sum(stby)::DOUBLE / greatest(1, sum(in_wafer)) AS stby_ratio FROM px GROUP BY sample_id""", ("px",))
part("f_radial", f"SELECT sample_id, {zone_sql('radius', 5, RZ)} FROM pol GROUP BY sample_id", ("pol",))
part("f_angular", f"SELECT sample_id, {zone_sql('theta', 12, AS)} FROM pol GROUP BY sample_id", ("pol",))
part("f_edge", f"SELECT sample_id, {frate(4)} AS edge_density, {frate(0)} AS center_density, "
     f"{frate(4)} - {frate(0)} AS edge_minus_center_density FROM pol GROUP BY sample_id", ("pol",))
part("f_faces", """SELECT i.sample_id, coalesce(outer_rate - inner_rate, 0.0) AS edge_chip_outer_minus_inner_density
FROM (SELECT DISTINCT sample_id FROM px) i LEFT JOIN (
  SELECT sample_id,
    sum(CASE WHEN face>0.66 AND severity>0 THEN 1 ELSE 0 END)::DOUBLE/greatest(1,sum(CASE WHEN face>0.66 THEN 1 ELSE 0 END)) outer_rate,
    sum(CASE WHEN face<0.34 AND severity>0 THEN 1 ELSE 0 END)::DOUBLE/greatest(1,sum(CASE WHEN face<0.34 THEN 1 ELSE 0 END)) inner_rate
  FROM (SELECT *, (radius-rmin)/(rmax-rmin) AS face FROM (
      SELECT *, min(radius) OVER (PARTITION BY sample_id,chip_row,chip_col) rmin,
                max(radius) OVER (PARTITION BY sample_id,chip_row,chip_col) rmax FROM pol WHERE valid=1)
    WHERE rmax>=0.78 AND rmax>rmin)
  GROUP BY sample_id) f ON f.sample_id=i.sample_id""", ("px", "pol"))
part("chips", """SELECT *, CASE WHEN n_valid>0 THEN sev_sum::DOUBLE/(7.0::DOUBLE*n_valid) ELSE 0.0 END AS value,
   dx2*dx2+dy2*dy2 AS d2,
   fmod(atan2(dx2/2.0, -(dy2/2.0)) + 2*pi(), 2*pi())/(2*pi()) AS theta FROM (
  SELECT sample_id, chip_row, chip_col, 4*(2*chip_col+1)-23 AS dx2, 4*(2*chip_row+1)-23 AS dy2, count(*) AS n_px,
    sum(in_wafer) AS n_wafer, sum(valid) AS n_valid, sum(in_wafer*stby) AS n_stby,
    sum(CASE WHEN valid=1 AND severity>0 THEN 1 ELSE 0 END) AS n_fail,
    sum(CASE WHEN valid=1 THEN severity ELSE 0 END) AS sev_sum
  FROM px GROUP BY ALL)""", ("px",))
part("chipw", """SELECT *, sqrt(d2::DOUBLE)/greatest(sqrt((max(CASE WHEN n_wafer>0 THEN d2 END)
   OVER (PARTITION BY sample_id))::DOUBLE),2.0) AS radius FROM chips""", ("chips",))
part("chipv", """SELECT *, sqrt(d2::DOUBLE)/greatest(sqrt((max(CASE WHEN n_valid>0 THEN d2 END)
   OVER (PARTITION BY sample_id))::DOUBLE),2.0) AS radius FROM chips""", ("chips",))
part("polcells", """SELECT sample_id, least(floor(least(radius,0.999999)*3),2)::INT AS r,
   least(floor(least(theta,0.999999)*12),11)::INT AS a,
   coalesce(avg(CASE WHEN n_valid>0 THEN value END),0.0) AS severity,
   sum(CASE WHEN n_valid>0 AND value>0 THEN 1 ELSE 0 END)::DOUBLE/greatest(1,sum(CASE WHEN n_valid>0 THEN 1 ELSE 0 END)) AS fail_density,
   avg(n_stby::DOUBLE/n_wafer) AS stby FROM chipw WHERE n_wafer>0 GROUP BY 1,2,3""", ("chipw",))
part("f_polar", "SELECT sample_id, " + ", ".join(
    f"coalesce(max(CASE WHEN r={r} AND a={a} THEN {col} END),0.0) AS {pre}polar_r{r:02d}_a{a:02d}_{suf}"
    for r in range(3) for a in range(12)
    for pre, col, suf in (("", "severity", "severity"), ("", "fail_density", "fail_density"), ("stby_", "stby", "ratio")))
    + " FROM polcells GROUP BY sample_id", ("polcells",))
for _pos, _pre in (("radius", "ring_radial"), ("theta", "scratch_angular")):
    part(f"prof_{_pos}", f"""SELECT i.sample_id, b.bin, coalesce(m, 0.0) AS m
FROM (SELECT DISTINCT sample_id FROM px) i CROSS JOIN (SELECT unnest(range(24)) AS bin) b LEFT JOIN (
  SELECT sample_id, least(floor(least({_pos},0.999999)*24),23)::INT AS bin, sum(severity)::DOUBLE/(7.0::DOUBLE*count(*)) AS m
  FROM pol WHERE valid=1 GROUP BY 1,2) p ON p.sample_id=i.sample_id AND p.bin=b.bin""", ("px", "pol"))
    part(f"f_{_pre}", f"""SELECT sample_id, mx-md AS {_pre}_peak_contrast,
  CASE WHEN mx-md<=1e-6 THEN 0.0 ELSE wide/24.0::DOUBLE END AS {_pre}_peak_width_ratio FROM (
  SELECT sample_id, max(mx) mx, max(md) md, sum(CASE WHEN m >= md+0.5*(mx-md) THEN 1 ELSE 0 END) wide FROM (
    SELECT *, max(m) OVER (PARTITION BY sample_id) mx, median(m) OVER (PARTITION BY sample_id) md FROM prof_{_pos})
  GROUP BY sample_id)""", (f"prof_{_pos}",))
part("chipstat", """SELECT sample_id, median(value) med, stddev_pop(value) sd, quantile_cont(value,0.84) q84,
   count(*) n FROM chips WHERE n_valid>0 GROUP BY 1""", ("chips",))
part("f_hot", """SELECT sample_id, mx-med AS local_hotspot_peak_contrast, top3-med AS local_hotspot_top3_mean_contrast,
  coalesce(spread,0.0)/sqrt(50.0) AS local_hotspot_top3_spread, hot::DOUBLE/n AS local_hotspot_count_ratio
FROM (SELECT c.sample_id, max(value) mx, max(med) med, avg(CASE WHEN k<=3 THEN value END) top3, max(n) n,
    sum(CASE WHEN value>med+2.0*sd THEN 1 ELSE 0 END) hot
  FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY value DESC, chip_row, chip_col) k
        FROM chips WHERE n_valid>0) c JOIN chipstat s ON s.sample_id=c.sample_id GROUP BY 1) g
LEFT JOIN (SELECT a.sample_id AS sid, avg(sqrt(((a.chip_row-b.chip_row)*(a.chip_row-b.chip_row)+(a.chip_col-b.chip_col)*(a.chip_col-b.chip_col))::DOUBLE)) spread
  FROM top3c a JOIN top3c b ON a.sample_id=b.sample_id AND a.k<b.k GROUP BY 1) d ON d.sid=g.sample_id""",
     ("chips", "chipstat", "top3c"))
part("top3c", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY value DESC, chip_row, chip_col) k
  FROM chips WHERE n_valid>0) WHERE k<=3""", ("chips",))
part("hotc", """SELECT c.sample_id, chip_row, chip_col, chip_row*6+chip_col AS cell, value, radius, theta, s.n
  FROM chipv c JOIN chipstat s ON s.sample_id=c.sample_id
  WHERE n_valid>0 AND value >= greatest(med+0.5*sd, q84)""", ("chipv", "chipstat"))
part("reach", """SELECT sample_id, cell, cell AS lab FROM hotc UNION
  SELECT h.sample_id, h.cell, r.lab FROM reach r JOIN hotc q ON q.sample_id=r.sample_id AND q.cell=r.cell
  JOIN hotc h ON h.sample_id=r.sample_id AND abs(h.chip_row-q.chip_row)<=1 AND abs(h.chip_col-q.chip_col)<=1""", ("hotc",))
part("regions", """SELECT h.*, l.region FROM hotc h JOIN (SELECT sample_id, cell, min(lab) region FROM reach GROUP BY 1,2) l
  ON l.sample_id=h.sample_id AND l.cell=h.cell""", ("hotc", "reach"))
part("regstat", """SELECT *, CASE WHEN size>=2 THEN sqrt((vr-vc)*(vr-vc)+4*vrc*vrc)/greatest(vr+vc,1e-6*size*greatest(size-1,1)) ELSE 0.0 END elongation
 FROM (SELECT g.sample_id, g.region, count(*) AS size, max(n) n,
   count(*)::DOUBLE/((max(chip_row)-min(chip_row)+1)*(max(chip_col)-min(chip_col)+1)) AS compactness,
   (count(*)*sum(chip_row*chip_row)-sum(chip_row)*sum(chip_row))::DOUBLE vr, (count(*)*sum(chip_col*chip_col)-sum(chip_col)*sum(chip_col))::DOUBLE vc,
   (count(*)*sum(chip_row*chip_col)-sum(chip_row)*sum(chip_col))::DOUBLE vrc, max(radius)-min(radius) radial_span,
   CASE WHEN count(*)<=1 THEN 0.0 ELSE 1.0-max(gap) END angular_span, avg(value) mean_value,
   avg(chip_row) centroid_row, avg(chip_col) centroid_col
 FROM (SELECT *, coalesce(lead(theta) OVER (PARTITION BY sample_id,region ORDER BY theta),
        min(theta) OVER (PARTITION BY sample_id,region)+1.0)-theta AS gap FROM regions) g GROUP BY 1,2)""", ("regions",))
part("regrank", """SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY round(mean_value,9) DESC, region) mp,
   row_number() OVER (PARTITION BY sample_id ORDER BY round(linear_score,9) DESC, region) lp FROM (
   SELECT *, greatest(0.0, elongation*least(1.0,size/6.0::DOUBLE)*(1.0-0.45*compactness)) AS linear_score FROM regstat)""", ("regstat",))
part("regpairs", """SELECT a.sample_id, avg(sqrt((trunc(a.centroid_row)-trunc(b.centroid_row))**2+(trunc(a.centroid_col)-trunc(b.centroid_col))**2)) spread,
   avg(sqrt((a.centroid_row-b.centroid_row)**2+(a.centroid_col-b.centroid_col)**2)) md,
   stddev_pop(sqrt((a.centroid_row-b.centroid_row)**2+(a.centroid_col-b.centroid_col)**2)) sdd, count(*) np
   FROM regrank a JOIN regrank b ON a.sample_id=b.sample_id AND a.mp<b.mp AND b.mp<=3 GROUP BY 1""", ("regrank",))
part("tri", """SELECT a.sample_id, abs((b.centroid_row-a.centroid_row)*(c.centroid_col-a.centroid_col)-(b.centroid_col-a.centroid_col)*(c.centroid_row-a.centroid_row))/2 area
   FROM regrank a JOIN regrank b ON a.sample_id=b.sample_id AND a.mp=1 AND b.mp=2
   JOIN regrank c ON c.sample_id=a.sample_id AND c.mp=3""", ("regrank",))
part("f_comp", """SELECT g.*, coalesce(spread,0.0)/sqrt(50.0) AS local_component_top3_spread,
  CASE WHEN area IS NULL OR md<=1e-6 THEN 0.0 ELSE greatest(0.0,1.0-sdd/md)*least(1.0,area/greatest(md*sqrt(50.0)/8.0,1e-6)) END
    AS local_component_triangle_score
FROM (SELECT sample_id, sum(size)::DOUBLE/max(n) AS morph_hot_chip_ratio, count(*)::DOUBLE/max(n) AS morph_component_count_ratio,
   max(size)::DOUBLE/max(n) AS local_component_largest_ratio, avg(CASE WHEN mp<=3 THEN compactness END) AS local_component_compactness,
   max(CASE WHEN lp=1 THEN elongation END) AS scratch_component_elongation, max(CASE WHEN lp=1 THEN linear_score END) AS scratch_component_linear_score,
   max(CASE WHEN lp=1 THEN radial_span END) AS scratch_component_radial_span, max(CASE WHEN lp=1 THEN angular_span END) AS scratch_component_angular_span
  FROM regrank GROUP BY 1) g LEFT JOIN regpairs p ON p.sample_id=g.sample_id LEFT JOIN tri t ON t.sample_id=g.sample_id""",
     ("regrank", "regpairs", "tri"))
part("esec", """SELECT sample_id, least(floor(least(theta,0.999999)*12),11) s, avg(value) v FROM chipv
  WHERE n_valid>0 AND radius>=0.78 GROUP BY 1,2""", ("chipv",))
part("f_eloc", """SELECT w.sample_id, coalesce(peak-coalesce(cmean,med),0.0) AS edge_chip_peak_contrast,
   coalesce(mx-smed,0.0) AS edge_sector_peak_contrast, coalesce(mx/greatest(tot,1e-6),0.0) AS edge_sector_concentration,
   coalesce(hi::DOUBLE/ns,0.0) AS edge_localized_sector_ratio
 FROM (SELECT sample_id, max(CASE WHEN radius>=0.78 THEN value END) peak, avg(CASE WHEN radius<0.55 THEN value END) cmean,
       median(value) med FROM chipv WHERE n_valid>0 GROUP BY 1) w
 LEFT JOIN (SELECT e.sample_id, max(v) mx, max(smed) smed, sum(v) tot, count(*) ns, sum(CASE WHEN v>smed+ssd THEN 1 ELSE 0 END) hi
   FROM esec e JOIN (SELECT sample_id, median(v) smed, stddev_pop(v) ssd FROM esec GROUP BY 1) z ON z.sample_id=e.sample_id GROUP BY 1) s
 ON s.sample_id=w.sample_id""", ("chipv", "esec"))
part("slots", """SELECT lr, lc, r, c, anchor, CASE anchor
   WHEN 'lower_left' THEN exp(-0.5*(((sx-0.18)/0.16)**2+((sy-0.82)/0.18)**2))
   WHEN 'bottom_edge' THEN exp(-0.5*((sy-0.92)/0.11)**2)*(0.55+0.45*exp(-0.5*((sx-0.42)/0.36)**2))
   ELSE exp(-0.5*((sx-0.08)/0.11)**2)*(0.55+0.45*exp(-0.5*((sy-0.58)/0.34)**2)) END AS weight
 FROM (SELECT lr, lc, a.v AS r, b.v AS c, (b.v+0.5::DOUBLE)/lc AS sx, (a.v+0.5::DOUBLE)/lr AS sy
   FROM (VALUES (3,3),(3,2),(2,3)) l(lr,lc), (SELECT unnest(range(3)) AS v) a, (SELECT unnest(range(3)) AS v) b
   WHERE a.v<lr AND b.v<lc) s,
   (VALUES ('lower_left'),('bottom_edge'),('left_edge')) an(anchor)""")
part("slotf", """SELECT lr, lc, r, c, anchor, weight >= greatest(0.38*max(weight) OVER w, 0.06) AS high,
   weight < greatest(0.22*max(weight) OVER w, 0.03) AS low FROM slots WINDOW w AS (PARTITION BY lr, lc, anchor)""", ("slots",))
part("f_shot", """SELECT *, greatest(shot_lower_left_contrast, shot_bottom_edge_contrast, shot_left_edge_contrast) AS shot_best_contrast
 FROM (SELECT sample_id,
  greatest(0.0, coalesce(max(CASE WHEN anchor='lower_left' THEN d END),0.0)) AS shot_lower_left_contrast,
  greatest(0.0, coalesce(max(CASE WHEN anchor='bottom_edge' THEN d END),0.0)) AS shot_bottom_edge_contrast,
  greatest(0.0, coalesce(max(CASE WHEN anchor='left_edge' THEN d END),0.0)) AS shot_left_edge_contrast
 FROM (SELECT k.sample_id, lr, lc, ro.range AS ro, co.range AS co, anchor,
    avg(CASE WHEN high THEN value END) - avg(CASE WHEN low THEN value END) AS d
   FROM chips k, range(3) ro, range(3) co, slotf s
   WHERE k.n_valid>0 AND ro.range<lr AND co.range<lc AND s.r=(k.chip_row-ro.range+6)%lr AND s.c=(k.chip_col-co.range+6)%lc
   GROUP BY ALL) GROUP BY 1)""", ("chips", "slotf"))
part("f_compact", "SELECT * FROM f_global " + " ".join(
    f"LEFT JOIN {f} USING (sample_id)" for f in
    ("f_radial", "f_angular", "f_edge", "f_faces", "f_ring_radial", "f_scratch_angular", "f_hot", "f_comp",
     "f_eloc", "f_shot")),
     ("f_global", "f_radial", "f_angular", "f_edge", "f_faces", "f_ring_radial", "f_scratch_angular", "f_hot",
      "f_comp", "f_eloc", "f_shot"))
part("f_all", "SELECT * FROM f_compact LEFT JOIN f_polar USING (sample_id)", ("f_compact", "f_polar"))

COMPACT = (["total_fail_density", "grade_weighted_severity", "stby_ratio"] + RZ + AS
           + ["edge_density", "center_density", "edge_minus_center_density", "edge_chip_outer_minus_inner_density",
              "ring_radial_peak_contrast", "ring_radial_peak_width_ratio",
              "scratch_angular_peak_contrast", "scratch_angular_peak_width_ratio",
              "local_hotspot_peak_contrast", "local_hotspot_top3_mean_contrast", "local_hotspot_top3_spread",
              "local_hotspot_count_ratio", "morph_hot_chip_ratio", "morph_component_count_ratio",
              "local_component_largest_ratio", "local_component_compactness", "local_component_top3_spread",
              "local_component_triangle_score", "scratch_component_elongation", "scratch_component_linear_score",
              "scratch_component_radial_span", "scratch_component_angular_span", "edge_chip_peak_contrast",
              "edge_sector_peak_contrast", "edge_sector_concentration", "edge_localized_sector_ratio",
              "shot_lower_left_contrast", "shot_bottom_edge_contrast", "shot_left_edge_contrast",
              "shot_best_contrast"])
POLAR = [n for r in range(3) for a in range(12) for n in
         (f"polar_r{r:02d}_a{a:02d}_severity", f"polar_r{r:02d}_a{a:02d}_fail_density",
          f"stby_polar_r{r:02d}_a{a:02d}_ratio")]


def r9sql(names):
    return ", ".join(f"round({n}, 9) AS {n}" for n in names)


# ---- registered queries
PX = "sample_id, y, x, severity, in_wafer, valid, stby, chip_row, chip_col"


@query("s01_pixel_table", f"SELECT {PX}, scratch, ring, edge, local, shot_grid, stby_pattern FROM px", ("px",))
def _(spark, sf):
    return demo.pixels(spark, sf).select(*[c.strip() for c in PX.split(",")], "scratch", "ring", "edge", "local",
                                         "shot_grid", "stby_pattern")


@query("p02_normalised_severity", "SELECT sample_id, y, x, severity::DOUBLE/7.0::DOUBLE AS value FROM px WHERE valid=1",
       ("px",))
def _(spark, sf):
    return demo.pixels(spark, sf).filter("valid = 1").select(
        "sample_id", "y", "x", fc.normalised_severity(F.col("severity")).alias("value"))


@query("p04_pixel_polar", "SELECT sample_id, y, x, round(radius,9) AS radius, round(theta,9) AS theta FROM pol", ("pol",))
def _(spark, sf):
    return polar(spark, sf).select("sample_id", "y", "x", F.round("radius", 9).alias("radius"),
                                   F.round("theta", 9).alias("theta"))


@query("p05_chip_polar", "SELECT sample_id, chip_row, chip_col, round(radius,9) AS radius, round(theta,9) AS theta FROM chipv",
       ("chipv",))
def _(spark, sf):
    return gm.with_chip_polar(chip_table(spark, sf), "n_valid").select(
        "sample_id", "chip_row", "chip_col", F.round("radius", 9).alias("radius"), F.round("theta", 9).alias("theta"))


@query("p06_pixel_to_chip", "SELECT sample_id, y, x, y//4 AS chip_row, x//4 AS chip_col FROM px WHERE in_wafer=1", ("px",))
def _(spark, sf):
    return gm.chip_of_pixel(demo.pixels(spark, sf).filter("in_wafer = 1"), GEO).select(
        "sample_id", "y", "x", "chip_row", "chip_col")


@query("p13_shot_anchor_weight", """SELECT k.sample_id, k.chip_row, k.chip_col, s.lr::INT AS shot_rows, s.lc::INT AS shot_cols, anchor, round(weight, 9) AS weight
FROM chips k JOIN slots s ON s.r=k.chip_row%s.lr AND s.c=k.chip_col%s.lc""", ("chips", "slots"))
def _(spark, sf):
    slots = ft.shot_weights(spark)  # 63 rows
    chips = chip_table(spark, sf).withColumn("l", F.explode(F.array(*[
        F.struct(F.lit(r).alias("shot_rows"), F.lit(c).alias("shot_cols")) for r, c in ft.SHOT_LAYOUTS])))
    placed = chips.select("sample_id", "chip_row", "chip_col", "l.*").withColumns(
        {"slot_r": F.col("chip_row") % F.col("shot_rows"), "slot_c": F.col("chip_col") % F.col("shot_cols")})
    return placed.join(F.broadcast(slots), ["shot_rows", "shot_cols", "slot_r", "slot_c"]).select(
        "sample_id", "chip_row", "chip_col", "shot_rows", "shot_cols", "anchor", F.round("weight", 9).alias("weight"))


@query("a01_global_densities", "SELECT * FROM f_global", ("f_global",))
def _(spark, sf):
    return ft.global_densities(demo.pixels(spark, sf))


@query("a02_radial_zones", "SELECT * FROM f_radial", ("f_radial",))
def _(spark, sf):
    return ft.radial_zones(polar(spark, sf))


@query("a03_angular_sectors", "SELECT * FROM f_angular", ("f_angular",))
def _(spark, sf):
    return ft.angular_sectors(polar(spark, sf))


@query("a04_edge_center_density", "SELECT * FROM f_edge", ("f_edge",))
def _(spark, sf):
    return ft.edge_center_density(polar(spark, sf))


@query("a05_edge_face_density", "SELECT * FROM f_faces", ("f_faces",))
def _(spark, sf):
    return ft.edge_face_density(polar(spark, sf), GEO)


@query("a06_chip_means", "SELECT sample_id, chip_row, chip_col, value, (n_valid>0)::INT AS tested FROM chips", ("chips",))
def _(spark, sf):
    return gm.chips(demo.pixels(spark, sf), GEO).select("sample_id", "chip_row", "chip_col", "value",
                                                        (F.col("n_valid") > 0).cast("int").alias("tested"))


@query("a07_chip_stby", """SELECT sample_id, chip_row, chip_col, (n_wafer>0)::INT AS in_wafer,
  CASE WHEN n_wafer>0 THEN n_stby::DOUBLE/n_wafer ELSE 0.0 END AS stby_share FROM chips""", ("chips",))
def _(spark, sf):
    return gm.chips(demo.pixels(spark, sf), GEO).select(
        "sample_id", "chip_row", "chip_col", (F.col("n_wafer") > 0).cast("int").alias("in_wafer"),
        fc.ratio(F.col("n_stby"), F.col("n_wafer")).alias("stby_share"))


@query("a08_polar_grid", f"SELECT sample_id, {r9sql(POLAR)} FROM f_polar", ("f_polar",))
def _(spark, sf):
    return rounded(ft.polar_features(chip_table(spark, sf)), digits=9)


@query("a09_profile_peaks", "SELECT r.sample_id, " + r9sql(
    ["ring_radial_peak_contrast", "ring_radial_peak_width_ratio", "scratch_angular_peak_contrast",
     "scratch_angular_peak_width_ratio"]) + " FROM f_ring_radial r JOIN f_scratch_angular a ON a.sample_id=r.sample_id",
       ("f_ring_radial", "f_scratch_angular"))
def _(spark, sf):
    return rounded(ft.profile_peaks(polar(spark, sf)), digits=9)


@query("a10_local_hotspots", "SELECT sample_id, " + r9sql(COMPACT[28:32]) + " FROM f_hot", ("f_hot",))
def _(spark, sf):
    return rounded(ft.local_hotspots(chip_table(spark, sf)), digits=9)


@query("a11_component_features", "SELECT sample_id, " + r9sql(COMPACT[32:42]) + " FROM f_comp", ("f_comp",))
def _(spark, sf):
    return rounded(ft.component_features(chip_table(spark, sf)), digits=9)


@query("a11b_hot_regions", "SELECT sample_id, chip_row, chip_col, region FROM regions", ("regions",))
def _(spark, sf):
    hot = cmp.hot_chip_regions(gm.with_chip_polar(chip_table(spark, sf), "n_valid"))
    return hot.select("sample_id", "chip_row", "chip_col", "region")


@query("a11c_region_stats", """SELECT sample_id, region, size, round(compactness,6) AS compactness, round(elongation,6) AS elongation,
  round(linear_score,6) AS linear_score, round(radial_span,6) AS radial_span, round(angular_span,6) AS angular_span,
  round(mean_value,6) AS mean_value FROM regrank""", ("regrank",))
def _(spark, sf):
    stats = cmp.region_stats(cmp.hot_chip_regions(gm.with_chip_polar(chip_table(spark, sf), "n_valid")))
    return rounded(stats.select("sample_id", "region", "size", "compactness", "elongation", "linear_score",
                                "radial_span", "angular_span", "mean_value"))


@query("a12_edge_localized", "SELECT sample_id, " + r9sql(COMPACT[42:46]) + " FROM f_eloc", ("f_eloc",))
def _(spark, sf):
    return rounded(ft.edge_localized(chip_table(spark, sf)), digits=9)


@query("a13_shot_contrast", "SELECT sample_id, " + r9sql(COMPACT[46:50]) + " FROM f_shot", ("f_shot",))
def _(spark, sf):
    return rounded(ft.shot_contrasts(chip_table(spark, sf)), digits=9)


RATIOS = ", ".join(f"sum({c})::DOUBLE/greatest(1,sum(in_wafer)) AS {c}_mask_ratio" for c in C.PATTERN_CLASSES)


@query("a14_mask_ratios", f"SELECT sample_id, {RATIOS} FROM px GROUP BY 1", ("px",))
def _(spark, sf):
    return ft.mask_ratios(demo.pixels(spark, sf), C.PATTERN_CLASSES)


@query("a15_profiles", """SELECT sample_id, kind, bin, round(m, 9) AS mean FROM (
  SELECT sample_id, 'radial' AS kind, bin, m FROM prof_radius UNION ALL SELECT sample_id, 'angular', bin, m FROM prof_theta)""",
       ("prof_radius", "prof_theta"))
def _(spark, sf):
    p = polar(spark, sf)
    both = (ft.bin_profile(p, "radius", 24).withColumn("kind", F.lit("radial"))
            .unionByName(ft.bin_profile(p, "theta", 24).withColumn("kind", F.lit("angular"))))
    return both.select("sample_id", "kind", F.posexplode("profile").alias("bin", "m")).select(
        "sample_id", "kind", "bin", F.round("m", 9).alias("mean"))


part("labels25", "SELECT sample_id, " + ", ".join(f"max({c}) AS label_{c}" for c in C.PATTERN_CLASSES)
     + " FROM px GROUP BY 1", ("px",))


@query("a25_class_labels", "SELECT * FROM labels25", ("labels25",))
def _(spark, sf):
    return ft.class_labels(demo.pixels(spark, sf), C.PATTERN_CLASSES)


@query("s20_feature_table", f"SELECT sample_id, 32 AS actual_net_die, {r9sql(COMPACT)}, {r9sql(POLAR)} FROM f_all", ("f_all",))
def _(spark, sf):
    return rounded(ft.all_features(demo.pixels(spark, sf), GEO), digits=9).withColumn("actual_net_die", F.lit(32))
