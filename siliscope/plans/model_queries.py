"""Model, clustering, resampling and remaining window queries with their check SQL."""
from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from siliscope import constants as C
from siliscope.functions import columns as fc
from siliscope.operators import chipsize
from siliscope.operators import components as cmp
from siliscope.operators import features as ft
from siliscope.operators import geometry as gm
from siliscope.operators import models as md
from siliscope.operators import pixelscores as px_scores
from siliscope.operators import retrieval as rt
from siliscope.operators import search
from siliscope.operators import statistics as st
from siliscope.plans import demo
from siliscope.plans.feature_queries import COMPACT, polar, rounded
from siliscope.plans.map_queries import G, cells
from siliscope.plans.registry import part, query
from siliscope.plans.search_queries import K, rounded9, staged_once, wafer_features, wafer_neighbors, wafer_signatures
from siliscope.operators import pooling as pl
from siliscope.operators import regions as rg
from siliscope.sources import arrays
from siliscope.sources import catalog as catalog_io
from siliscope.sources.staging import shared_folder


def points(spark, sf):
    return staged_once(spark, sf, "points", lambda: search.standardised(wafer_features(spark, sf), COMPACT))


@query("m01_pca")
def _(spark, sf):
    coords, explained = md.pca(points(spark, sf), 2)
    return coords.select("id", F.round(F.col("coords")[0], 6).alias("pca_0"), F.round(F.col("coords")[1], 6).alias("pca_1"),
                         F.lit(round(explained[0], 6)).alias("explained_0"), F.lit(round(explained[1], 6)).alias("explained_1"))


@query("m02_pca_embedding")
def _(spark, sf):
    return md.pca_embedding(pl.input_tensor(cells(spark, sf), G), 4)


@query("m03_kmeans")
def _(spark, sf):
    return md.kmeans(points(spark, sf), 5, 7)[0]


# clusters that follow from the wafer number, so that the summaries can be stated in SQL
part("fixc", "SELECT DISTINCT sample_id AS id, (w%3)::INT AS cluster_id FROM px", ("px",))


def fixed_clusters(spark, sf):
    return points(spark, sf).select("id", (F.substring("id", 2, 9).cast("long") % 3).cast("int").alias("cluster_id"),
                                    F.lit(0.0).alias("distance"))


@query("m03_cluster_deviations", """SELECT cluster_id, feature, round(mean_z,6) AS mean_z, place FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY round(abs(mean_z),9) DESC, feature) AS place FROM (
   SELECT cluster_id, feature, avg(z) AS mean_z FROM zc JOIN fixc ON fixc.id=zc.id GROUP BY 1,2)) WHERE place<=6""", ("zc", "fixc"))
def _(spark, sf):
    return rounded(md.cluster_deviations(points(spark, sf), fixed_clusters(spark, sf), COMPACT), keep=())


@query("m03_cluster_label_rates", "SELECT cluster_id, count(*) AS size, " + ", ".join(f"round(avg(label_{c}),9) AS rate_{c}" for c in C.REPORT_CLASSES)
       + " FROM fixc JOIN labels25 l ON l.sample_id=fixc.id GROUP BY 1", ("fixc", "labels25"))
def _(spark, sf):
    return rounded9(md.cluster_label_rates(fixed_clusters(spark, sf), wafer_features(spark, sf), C.REPORT_CLASSES))


part("centerd", """SELECT z.id, z.cluster_id, sqrt(sum((z.z-c.m)*(z.z-c.m))) AS distance FROM (SELECT zc.*, cluster_id FROM zc JOIN fixc ON fixc.id=zc.id) z
   JOIN (SELECT cluster_id, feature, avg(z) m FROM zc JOIN fixc ON fixc.id=zc.id GROUP BY 1,2) c ON c.cluster_id=z.cluster_id AND c.feature=z.feature GROUP BY 1,2""", ("zc", "fixc"))


@query("m03_representatives", """SELECT cluster_id, id, round(distance,6) AS distance, place FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY round(distance,9), id) AS place FROM centerd) WHERE place<=5""", ("centerd",))
def _(spark, sf):
    p = points(spark, sf).join(fixed_clusters(spark, sf).select("id", "cluster_id"), "id")
    mean = (p.select("cluster_id", F.posexplode("vec").alias("i", "v")).groupBy("cluster_id", "i").agg(F.avg("v").alias("m"))
            .groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("c")).select("cluster_id", F.col("c.m").alias("center")))
    gap = F.zip_with("vec", "center", lambda a, b: (a - b) * (a - b))
    placed = p.join(F.broadcast(mean), "cluster_id").select("id", "cluster_id", F.sqrt(F.aggregate(gap, F.lit(0.0), lambda s, v: s + v)).alias("distance"))
    return md.representatives(placed).withColumn("distance", F.round("distance", 6)).select("cluster_id", "id", "distance", "place")


RUNS = 6
part("runc", f"SELECT DISTINCT r::INT AS run, sample_id AS id, ((w*(r+2)+r)%4)::INT AS cluster_id FROM px, range({RUNS}) t(r)", ("px",))


def run_clusters(spark, sf):
    w = F.substring("id", 2, 9).cast("long")
    return (points(spark, sf).select("id", F.explode(F.sequence(F.lit(0), F.lit(RUNS - 1))).alias("run"))
            .withColumn("cluster_id", ((w * (F.col("run") + 2) + F.col("run")) % 4).cast("int")))


part("coas", f"""SELECT a.id AS l, b.id AS r, ba.cluster_id AS ca, bb.cluster_id AS cb, sum((a.cluster_id=b.cluster_id)::INT)/{RUNS}.0::DOUBLE AS co FROM runc a JOIN runc b ON a.run=b.run AND a.id<b.id
   JOIN fixc ba ON ba.id=a.id JOIN fixc bb ON bb.id=b.id GROUP BY 1,2,3,4""", ("runc", "fixc"))


@query("j12_coassociation", """SELECT round(s,9) AS same_cluster_mean_coassociation, round(d,9) AS different_cluster_mean_coassociation, round(s-d,9) AS coassociation_separation
   FROM (SELECT avg(CASE WHEN ca=cb THEN co END) s, avg(CASE WHEN ca<>cb THEN co END) d FROM coas)""", ("coas",))
def _(spark, sf):
    return rounded9(md.coassociation(fixed_clusters(spark, sf), run_clusters(spark, sf)))


@query("r13_cluster_coassociation", "SELECT ca AS cluster_id, (SELECT count(*) FROM fixc WHERE cluster_id=ca) AS size, round(avg(co),9) AS internal_coassociation FROM coas WHERE ca=cb GROUP BY 1", ("coas", "fixc"))
def _(spark, sf):
    return rounded9(md.cluster_coassociation(fixed_clusters(spark, sf), run_clusters(spark, sf)))


@query("r13_fragile_pairs", "SELECT ca AS cluster_id, l AS left_id, r AS right_id, round(co,9) AS coassociation, place FROM (SELECT *, row_number() OVER (PARTITION BY ca ORDER BY round(co,9), l, r) AS place FROM coas WHERE ca=cb) WHERE place<=3", ("coas",))
def _(spark, sf):
    return rounded9(md.fragile_pairs(fixed_clusters(spark, sf), run_clusters(spark, sf), RUNS))


# ---- the same summaries over clusters that were fitted: five on the features, 64 runs on perturbed ones
def fitted_clusters(spark, sf):
    return staged_once(spark, sf, "fitted_clusters", lambda: md.kmeans(points(spark, sf), 5, 7)[0])


def fitted_runs(spark, sf):
    """(baseline, runs) of the published stability check."""
    both = {}

    def build(which):
        if not both:
            _, both["base"], both["runs"] = md.repeated_clusterings(points(spark, sf), len(COMPACT), 64, {5: 17})
        return both[which].drop("clusters")

    return tuple(staged_once(spark, sf, f"fitted_{name}", lambda name=name: build(name)) for name in ("base", "runs"))


@query("m03_fitted_deviations")
def _(spark, sf):
    return md.cluster_deviations(points(spark, sf), fitted_clusters(spark, sf), COMPACT)


@query("m03_fitted_label_rates")
def _(spark, sf):
    return md.cluster_label_rates(fitted_clusters(spark, sf), wafer_features(spark, sf), C.REPORT_CLASSES)


@query("m03_fitted_representatives")
def _(spark, sf):
    return md.representatives(fitted_clusters(spark, sf))


@query("j12_fitted_coassociation")
def _(spark, sf):
    return md.coassociation(*fitted_runs(spark, sf))


@query("r13_fitted_coassociation")
def _(spark, sf):
    return md.cluster_coassociation(*fitted_runs(spark, sf))


@query("r13_fitted_fragile_pairs")
def _(spark, sf):
    return md.fragile_pairs(*fitted_runs(spark, sf), 64)


@query("r13_neighbor_stability")
def _(spark, sf):
    return md.stability(points(spark, sf), len(COMPACT), 64, {5: 17}, K)[0].drop("clusters")


@query("r14_parameter_sweep")
def _(spark, sf):
    out = md.stability(points(spark, sf), len(COMPACT), 40, {k: 17 + k * 17 for k in range(3, 9)}, 3)[0]
    passes = (F.col("same_cluster_mean_coassociation") >= 0.55) & (F.col("coassociation_separation") >= 0.20) & (F.col("mean_neighbor_overlap") >= 0.30)
    order = Window.orderBy(passes.cast("int").desc(), F.col("coassociation_separation").desc(), "clusters")
    return out.withColumn("place", F.row_number().over(order))


@query("r14_top_k_sweep", """SELECT k::INT AS k, round(avg(jaccard),9) AS mean_neighbor_label_jaccard, round(avg(jaccard)/greatest((SELECT m FROM chance),1e-9),9) AS lift FROM nnj10, (VALUES (3),(5),(10)) v(k) WHERE rank<=k GROUP BY 1""", ("nnj10", "chance"))
def _(spark, sf):
    # one neighbour table at the largest k answers the smaller ones
    nn = wafer_neighbors(spark, sf, 10).withColumn("k", F.explode(F.array(F.lit(3), F.lit(5), F.lit(10)))).filter(F.col("rank") <= F.col("k"))
    return rounded9(rt.label_lift(nn, wafer_signatures(spark, sf), by=("k",))).drop("random_pair_label_jaccard")


# ---- encoder
def tensor_rows(spark, sf):
    flags = F.array(*[F.col(f"label_{c}") for c in C.REPORT_CLASSES])
    y = wafer_features(spark, sf).select(F.col("sample_id").alias("id"), flags.alias("y"), *[f"label_{c}" for c in C.REPORT_CLASSES])
    return staged_once(spark, sf, "tensors", lambda: pl.input_tensor(cells(spark, sf), G).join(y, "id").join(wafer_signatures(spark, sf), "id"))


def trained(spark, sf):
    rows = tensor_rows(spark, sf)
    return md.train_encoder(md.new_encoder(rows, 32, 16, C.REPORT_CLASSES), rows, epochs=40, rate=0.2, pair_weight=0.5, l2=1e-4)


@query("m04_encoder_training")
def _(spark, sf):
    history = trained(spark, sf)[1]
    return spark.createDataFrame([(i + 1, h["total"], h["bce"], h["pairwise"], h["l2"]) for i, h in enumerate(history)],
                                 "epoch int, total double, bce double, pairwise double, l2 double")


FIXED_IN = ["total_fail_density", "grade_weighted_severity", "stby_ratio", "edge_density"]


def fixed_encoder():
    """Small weights given by a formula, so that the forward pass can be written in SQL."""
    def grid(i, j, a, b):
        return np.array([[((r * a + c * b) % 5 - 2) / 4.0 for c in range(j)] for r in range(i)])
    return md.Encoder(np.full(4, 0.25), np.full(4, 0.5), grid(4, 3, 7, 3), np.full(3, 0.1), grid(3, 2, 3, 2), np.zeros(2), grid(2, 6, 2, 7), np.full(6, -0.2), C.REPORT_CLASSES)


def wsql(r, c, a, b):
    return f"({((r * a + c * b) % 5 - 2) / 4.0}::DOUBLE)"


_x = [f"(({n}-0.25::DOUBLE)/0.5::DOUBLE)" for n in FIXED_IN]
part("enc", f"""SELECT sample_id AS id, {', '.join(f"z0*{wsql(0, c, 2, 7)}+z1*{wsql(1, c, 2, 7)}-0.2::DOUBLE AS g{c}" for c in range(6))}, z0/greatest(sqrt(z0*z0+z1*z1),1e-12) AS e0, z1/greatest(sqrt(z0*z0+z1*z1),1e-12) AS e1
 FROM (SELECT sample_id, {', '.join(f"tanh(h0*{wsql(0, c, 3, 2)}+h1*{wsql(1, c, 3, 2)}+h2*{wsql(2, c, 3, 2)}) AS z{c}" for c in range(2))} FROM (SELECT sample_id, {', '.join(
    f"tanh({'+'.join(f'{_x[i]}*{wsql(i, c, 7, 3)}' for i in range(4))}+0.1::DOUBLE) AS h{c}" for c in range(3))} FROM f_compact))""", ("f_compact",))


def scored(spark, sf):
    v = wafer_features(spark, sf).select(F.col("sample_id").alias("id"), F.array(*FIXED_IN).alias("vec"))
    return md.encode(fixed_encoder(), v)


@query("m05_encoder_scores", f"SELECT id, {', '.join(f'round(1/(1+exp(-g{c})),6) AS prob_{n}' for c, n in enumerate(C.REPORT_CLASSES))}, round(e0,6) AS embedding_00, round(e1,6) AS embedding_01 FROM enc", ("enc",))
def _(spark, sf):
    return rounded(md.prediction_table(scored(spark, sf), C.REPORT_CLASSES, 2), keep=()).drop("top_label")


@query("m05_scored_with_status", f"""SELECT id, CASE WHEN bad THEN 'FAIL' ELSE 'PASS' END AS sanity, CASE WHEN bad THEN 'SKIPPED' ELSE 'SCORED' END AS status, CASE WHEN NOT bad THEN round(greatest({','.join(f'1/(1+exp(-g{c}))' for c in range(6))}),6) END AS top_probability
   FROM (SELECT *, substr(id,2)::BIGINT%5=2 AS bad FROM enc)""", ("enc",))
def _(spark, sf):
    bad = F.substring("sample_id", 2, 9).cast("long") % 5 == 2
    v = wafer_features(spark, sf).select(F.col("sample_id").alias("id"), F.when(bad, "FAIL").otherwise("PASS").alias("sanity"),
                                         F.when(bad, "SKIPPED").otherwise("SCORED").alias("status"), F.when(~bad, F.array(*FIXED_IN)).alias("vec"))
    out = md.encode(fixed_encoder(), v).withColumns(st.score_uncertainty(F.col("probs"), C.REPORT_CLASSES))
    return out.select("id", "sanity", "status", F.round("top_probability", 6).alias("top_probability"))


@query("m06_encoder_evaluation", """SELECT class_name, sum(truth)::BIGINT AS positives, sum(pred)::BIGINT AS predicted, coalesce(sum(truth*pred)::DOUBLE/nullif(sum(pred),0),0.0) AS precision, coalesce(sum(truth*pred)::DOUBLE/nullif(sum(truth),0),0.0) AS recall, round(avg(ce),6) AS bce FROM ("""
       + " UNION ALL ".join(f"SELECT '{n}' AS class_name, label_{n} AS truth, (1/(1+exp(-g{c}))>=0.5)::INT AS pred, -(label_{n}*ln(1/(1+exp(-g{c}))+1e-6)+(1-label_{n})*ln(1-1/(1+exp(-g{c}))+1e-6)) AS ce FROM enc JOIN labels25 l ON l.sample_id=enc.id"
                            for c, n in enumerate(C.REPORT_CLASSES)) + ") GROUP BY 1", ("enc", "labels25"))
def _(spark, sf):
    s = scored(spark, sf).join(wafer_features(spark, sf).withColumnRenamed("sample_id", "id"), "id")
    rows = F.array(*[F.struct(F.lit(n).alias("class_name"), F.col(f"label_{n}").alias("truth"), F.col("probs")[i].alias("p")) for i, n in enumerate(C.REPORT_CLASSES)])
    long = s.select(F.explode(rows).alias("r")).select("r.*").withColumn("pred", (F.col("p") >= 0.5).cast("int"))
    loss = long.groupBy("class_name").agg(F.round(F.avg(st.cross_entropy(F.col("truth").cast("double"), F.col("p"))), 6).alias("bce"))
    return st.confusion(long).drop("iou").join(loss, "class_name")


@query("m09_prediction_table", f"""SELECT id, {', '.join(f'label_{c}' for c in C.REPORT_CLASSES)}, {', '.join(f'round(1/(1+exp(-g{c})),6) AS prob_{n}' for c, n in enumerate(C.REPORT_CLASSES))},
   [{', '.join(repr(n) for n in C.REPORT_CLASSES)}][list_position([{', '.join(f'g{c}' for c in range(6))}], greatest({', '.join(f'g{c}' for c in range(6))}))] AS top_label, round(e0,6) AS embedding_00, round(e1,6) AS embedding_01
   FROM enc JOIN labels25 l ON l.sample_id=enc.id""", ("enc", "labels25"))
def _(spark, sf):
    s = scored(spark, sf).join(wafer_features(spark, sf).select(F.col("sample_id").alias("id"), *[f"label_{c}" for c in C.REPORT_CLASSES]), "id")
    t = md.prediction_table(s, C.REPORT_CLASSES, 2)
    return t.withColumns({n: F.round(n, 6) for n in t.columns if n.startswith(("prob_", "embedding_"))})


# ---- linear segmentation: eight full-batch steps
CH = ["severity", "any_in_wafer", "any_valid", "any_stby"]
TG = [f"any_{c}" for c in C.PATTERN_CLASSES]
NT, STEPS = len(TG), 8
part("seg", "SELECT sev_all::DOUBLE/(7.0::DOUBLE*area) AS severity, any_in_wafer::DOUBLE AS any_in_wafer, any_valid::DOUBLE AS any_valid, any_stby::DOUBLE AS any_stby, " + ", ".join(f"{t}::DOUBLE AS y{j}" for j, t in enumerate(TG))
     + ", " + ", ".join(f"avg({t}) OVER () AS pv{j}" for j, t in enumerate(TG)) + " FROM pool", ("pool",))
for _step in range(STEPS):
    _prev = f"w{_step}"
    _logit = {j: (f"(SELECT b{j} FROM segw{_step})" + "".join(f"+{ch}*(SELECT w{i}_{j} FROM segw{_step})" for i, ch in enumerate(CH))) for j in range(NT)} if _step else {j: "0.0" for j in range(NT)}
    part(f"segp{_step + 1}", "SELECT *, " + ", ".join(f"(1/(1+exp(-({_logit[j]})))-y{j})*CASE WHEN y{j}>0 THEN least((1-greatest(pv{j},1e-6))/greatest(pv{j},1e-6),50.0) ELSE 1.0 END AS g{j}" for j in range(NT)) + " FROM seg",
         ("seg",) + ((f"segw{_step}",) if _step else ()))
    _old = (lambda n: f"(SELECT {n} FROM segw{_step})") if _step else (lambda n: "0.0")
    part(f"segw{_step + 1}", "SELECT " + ", ".join([f"{_old(f'b{j}')}-0.5*avg(g{j}) AS b{j}" for j in range(NT)] + [f"{_old(f'w{i}_{j}')}-0.5*avg(g{j}*{ch}) AS w{i}_{j}" for j in range(NT) for i, ch in enumerate(CH)])
         + f" FROM segp{_step + 1}", (f"segp{_step + 1}",) + ((f"segw{_step}",) if _step else ()))


@query("m07_linear_segmentation", " UNION ALL ".join(f"SELECT '{c}' AS class_name, round(b{j},6) AS bias, " + ", ".join(f"round(w{i}_{j},6) AS w_{ch}" for i, ch in enumerate(CH)) + " FROM segw8" for j, c in enumerate(C.PATTERN_CLASSES)), ("segw8",))
def _(spark, sf):
    grid = cells(spark, sf).withColumn("severity", F.col("sev_all") / (7.0 * F.col("area")))
    w, b, _ = md.linear_segmentation(grid, CH, TG, steps=STEPS, rate=0.5)
    return spark.createDataFrame([(c, round(float(b[j]), 6), *[round(float(v), 6) for v in w[:, j]]) for j, c in enumerate(C.PATTERN_CLASSES)],
                                 "class_name string, bias double, " + ", ".join(f"w_{ch} double" for ch in CH))


@query("m08_score_forests")
def _(spark, sf):
    f = wafer_features(spark, sf)
    rows = f.select(F.array(*COMPACT).alias("vec"), rg.stable_split(F.col("sample_id"), 0.3, 11).alias("split"),
                    *[F.col(f"label_{c}").cast("double").alias(c) for c in C.REPORT_CLASSES])
    return md.score_forests(rows, list(C.REPORT_CLASSES), trees=260, depth=10)


# ---- remaining windows, sets and orders
@query("w02_top_chips", "SELECT sample_id, k::INT AS place, chip_row, chip_col FROM top3c", ("top3c",))
def _(spark, sf):
    chips = gm.chips(demo.pixels(spark, sf), gm.Geometry(**demo.GEOMETRY)).filter("n_valid > 0")
    order = Window.partitionBy("sample_id").orderBy(F.col("value").desc(), "chip_row", "chip_col")
    return chips.withColumn("place", F.row_number().over(order)).filter("place <= 3").select("sample_id", "place", "chip_row", "chip_col")


@query("w03_integral_image", """SELECT sample_id, y, x, sum(rowsum) OVER (PARTITION BY sample_id, x ORDER BY y)::BIGINT AS integral FROM (SELECT sample_id, y, x, sum(severity) OVER (PARTITION BY sample_id, y ORDER BY x) AS rowsum FROM px)""", ("px",))
def _(spark, sf):
    along = Window.partitionBy("sample_id", "y").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("sample_id", "x").orderBy("y").rowsBetween(Window.unboundedPreceding, 0)
    return (demo.pixels(spark, sf).repartition("sample_id").withColumn("rowsum", F.sum("severity").over(along))
            .select("sample_id", "y", "x", F.sum("rowsum").over(down).alias("integral")))


@query("w08_chip_radius_range", "SELECT DISTINCT sample_id, chip_row, chip_col, min(radius) OVER w AS r_min, max(radius) OVER w AS r_max FROM pol WINDOW w AS (PARTITION BY sample_id, chip_row, chip_col)", ("pol",))
def _(spark, sf):
    return polar(spark, sf).groupBy("sample_id", "chip_row", "chip_col").agg(F.min("radius").alias("r_min"), F.max("radius").alias("r_max"))


@query("w09_leave_one_lot_out", "SELECT lot_id, (sum(f) OVER ()-f)::DOUBLE/(sum(n) OVER ()-n) AS rate_elsewhere FROM (SELECT lot_id, sum((severity>0)::INT)::BIGINT f, sum(valid)::BIGINT n FROM px GROUP BY 1)", ("px",))
def _(spark, sf):
    lots = demo.pixels(spark, sf).groupBy("lot_id").agg(F.count_if(F.col("severity") > 0).alias("f"), F.sum("valid").alias("n"))
    total = lots.agg(F.struct(F.sum("f").alias("f"), F.sum("n").alias("n"))).scalar()
    return lots.withColumn("t", total).select("lot_id", ((F.col("t.f") - F.col("f")) / (F.col("t.n") - F.col("n"))).alias("rate_elsewhere"))


@query("w10_duplicate_ids", "SELECT c_nationkey, count(*) AS copies FROM customer GROUP BY 1 HAVING count(*)>1")
def _(spark, sf):
    return demo.table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


@query("l01_top_fail_wafers", "SELECT sample_id, total_fail_density FROM f_global ORDER BY total_fail_density DESC, sample_id LIMIT 5", ("f_global",))
def _(spark, sf):
    return (ft.global_densities(demo.pixels(spark, sf)).select("sample_id", "total_fail_density")
            .orderBy(F.col("total_fail_density").desc(), "sample_id").limit(5))


@query("l02_ordered_targets", """SELECT *, row_number() OVER (ORDER BY list_position(['class','class_radial','class_location','feature_key'], target_kind), class_name, support DESC, target_id) AS position FROM targets4""", ("targets4",))
def _(spark, sf):
    from siliscope.plans.region_queries import region_table
    t = rt.targets(region_table(spark, sf), wafer_features(spark, sf), 2)
    kind = F.array_position(F.array(*[F.lit(k) for k in rt.TARGET_KINDS]), F.col("target_kind"))
    # targets are combinations of class, zone and clock labels, a fixed vocabulary
    return t.withColumn("position", F.row_number().over(Window.orderBy(kind, "class_name", F.col("support").desc(), "target_id")))


@query("u05_train_val_union", "SELECT sample_id, split, total_fail_density FROM (SELECT f.*, " + "CASE WHEN ('0x'||substr(sha256('3:'||sample_id),1,12))::UBIGINT::DOUBLE/(16.0::DOUBLE**12) < 0.3 THEN 'val' ELSE 'train' END AS split FROM f_global f)", ("f_global",))
def _(spark, sf):
    f = ft.global_densities(demo.pixels(spark, sf)).withColumn("split", rg.stable_split(F.col("sample_id"), 0.3, 3)).select("sample_id", "split", "total_fail_density")
    return f.filter("split = 'train'").unionByName(f.filter("split = 'val'"))


@query("j13_validation_rows", "SELECT sample_id FROM (SELECT sample_id, CASE WHEN ('0x'||substr(sha256('5:'||sample_id),1,12))::UBIGINT::DOUBLE/(16.0::DOUBLE**12) < 0.0 THEN 'val' ELSE 'train' END AS split FROM f_global) WHERE split='train'", ("f_global",))
def _(spark, sf):
    f = ft.global_densities(demo.pixels(spark, sf)).withColumn("split", rg.stable_split(F.col("sample_id"), 0.0, 5))
    val = f.filter("split = 'val'")
    return (f.filter("split = 'train'") if val.isEmpty() else val).select("sample_id")


@query("u06_shared_label_hits", """SELECT query_id, count(*) FILTER (qs&ns>0 OR (qs=0 AND ns=0))::DOUBLE/count(*) AS precision, coalesce(1.0::DOUBLE/min(rank) FILTER (qs&ns>0 OR (qs=0 AND ns=0)),0.0) AS reciprocal_rank FROM nnj GROUP BY 1""", ("nnj",))
def _(spark, sf):
    def labels(s):
        names = F.array_compact(F.array(*[F.when(F.col(s).bitwiseAND(F.lit(1 << i).cast("long")) > 0, F.lit(c)) for i, c in enumerate(C.REPORT_CLASSES)]))
        return F.when(F.size(names) == 0, F.array(F.lit("normal"))).otherwise(names)
    rows = rt.with_signatures(wafer_neighbors(spark, sf), wafer_signatures(spark, sf)).withColumn(
        "hit", F.arrays_overlap(labels("query_signature"), labels("neighbor_signature")))
    return rows.groupBy("query_id").agg((F.count_if("hit") / F.count(F.lit(1))).alias("precision"),
                                        F.coalesce(1.0 / F.min(F.when(F.col("hit"), F.col("rank"))), F.lit(0.0)).alias("reciprocal_rank"))


@query("u07_distinct_ids", "SELECT count(DISTINCT sample_id) AS wafers, count(DISTINCT lot_id) AS lots FROM px", ("px",))
def _(spark, sf):
    return demo.pixels(spark, sf).agg(F.countDistinct("sample_id").alias("wafers"), F.countDistinct("lot_id").alias("lots"))


@query("p03_quantise", "SELECT l_orderkey, l_linenumber, " + "+".join(f"(l_extendedprice>={t})::INT" for t in (1000, 5000, 10000, 20000, 35000, 50000, 80000)) + " AS grade FROM lineitem")
def _(spark, sf):
    return demo.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", fc.quantise(F.col("l_extendedprice"), [1000, 5000, 10000, 20000, 35000, 50000, 80000]).alias("grade"))


# ---- pixel-level regions and the rule scores of the alternative feature space
part("fpx", "SELECT sample_id, y, x, y*24+x AS cell FROM px WHERE valid=1 AND severity>=3", ("px",))
part("freach", "SELECT sample_id, cell, cell AS lab FROM fpx UNION SELECT h.sample_id, h.cell, r.lab FROM freach r JOIN fpx q ON q.sample_id=r.sample_id AND q.cell=r.cell JOIN fpx h ON h.sample_id=r.sample_id AND abs(h.y-q.y)+abs(h.x-q.x)=1", ("fpx",))
part("freg", "SELECT f.*, l.region FROM fpx f JOIN (SELECT sample_id, cell, min(lab) AS region FROM freach GROUP BY 1,2) l ON l.sample_id=f.sample_id AND l.cell=f.cell", ("fpx", "freach"))


@query("a39_pixel_regions", "SELECT sample_id, region, count(*) AS area FROM freg GROUP BY 1,2", ("freg",))
def _(spark, sf):
    return px_scores.region_table(px_scores.fail_pixels(demo.pixels(spark, sf), 3)).select("sample_id", "region", "area")


@query("a39_component_scores", """SELECT i.sample_id, round(coalesce(max(scratch),0.0),6) AS scratch_score, round(coalesce(max(blob),0.0),6) AS blob_score, round(least(1.0,coalesce(max(area),0)/2500.0),6) AS area_score, round(least(1.0,count(area)/30.0::DOUBLE),6) AS component_count_score
  FROM (SELECT DISTINCT sample_id FROM px) i LEFT JOIN (SELECT *, least(1.0,greatest(0.0,(el-2.5)/12.0))*least(1.0,area/600.0) AS scratch, least(1.0,4*pi()*area/greatest(per*per,1.0))*least(1.0,area/500.0)*greatest(0.0,1.0-(el-1.0)/6.0) AS blob FROM (
   SELECT sample_id, region, area, per, sqrt((l1+1e-6)/(l2+1e-6)) AS el FROM (SELECT *, ((vy+vx)+sqrt((vy-vx)**2+4*vyx*vyx))/2 AS l1, ((vy+vx)-sqrt((vy-vx)**2+4*vyx*vyx))/2 AS l2 FROM (
    SELECT sample_id, region, count(*)::DOUBLE AS area, sum(edge)::DOUBLE AS per, (count(*)*sum(y*y)-sum(y)*sum(y))::DOUBLE/(count(*)*(count(*)-1)) AS vy, (count(*)*sum(x*x)-sum(x)*sum(x))::DOUBLE/(count(*)*(count(*)-1)) AS vx,
      (count(*)*sum(x*y)-sum(x)*sum(y))::DOUBLE/(count(*)*(count(*)-1)) AS vyx FROM (
     SELECT f.sample_id, f.region, f.y, f.x, CASE WHEN count(g.cell)<4 THEN 1 ELSE 0 END AS edge FROM freg f LEFT JOIN freg g ON g.sample_id=f.sample_id AND g.region=f.region AND abs(g.y-f.y)+abs(g.x-f.x)=1 GROUP BY 1,2,3,4) GROUP BY 1,2 HAVING count(*)>=12)))) s ON s.sample_id=i.sample_id GROUP BY 1""", ("freg", "px"))
def _(spark, sf):
    px = demo.pixels(spark, sf)
    return rounded(px_scores.component_scores(px, 3))


@query("a38_feature_space", """SELECT sample_id, pos, round(v,6) AS v FROM (
   SELECT sample_id, (severity-1)::INT AS pos, NULL::DOUBLE AS v FROM px WHERE false
   UNION ALL SELECT s.sample_id, g.g-1, sum((valid=1 AND severity=g.g)::INT)::DOUBLE/sum(valid) FROM px s, (SELECT unnest(range(1,8))::INT AS g) g GROUP BY 1,2
   UNION ALL SELECT k.sample_id, 7+k.b, coalesce(p.m,0.0) FROM (SELECT DISTINCT sample_id, b FROM px, range(32) t(b)) k LEFT JOIN (SELECT sample_id, least(floor(least(radius,0.999999)*32),31)::INT b, sum(severity)/7.0::DOUBLE/count(*) m FROM pol WHERE valid=1 GROUP BY 1,2) p ON p.sample_id=k.sample_id AND p.b=k.b
   UNION ALL SELECT k.sample_id, 39+k.b, coalesce(p.m,0.0) FROM (SELECT DISTINCT sample_id, b FROM px, range(36) t(b)) k LEFT JOIN (SELECT sample_id, least(floor(least(theta,0.999999)*36),35)::INT b, sum(severity)/7.0::DOUBLE/count(*) m FROM pol WHERE valid=1 GROUP BY 1,2) p ON p.sample_id=k.sample_id AND p.b=k.b
   UNION ALL SELECT k.sample_id, 75+k.b, coalesce(p.m,0.0) FROM (SELECT DISTINCT sample_id, b FROM px, range(32) t(b)) k LEFT JOIN (SELECT sample_id, (x*32//24)::INT b, sum(severity)/7.0::DOUBLE/count(*) m FROM pol WHERE valid=1 GROUP BY 1,2) p ON p.sample_id=k.sample_id AND p.b=k.b
   UNION ALL SELECT k.sample_id, 107+k.b, coalesce(p.m,0.0) FROM (SELECT DISTINCT sample_id, b FROM px, range(32) t(b)) k LEFT JOIN (SELECT sample_id, (y*32//24)::INT b, sum(severity)/7.0::DOUBLE/count(*) m FROM pol WHERE valid=1 GROUP BY 1,2) p ON p.sample_id=k.sample_id AND p.b=k.b)""", ("px", "pol"))
def _(spark, sf):
    return px_scores.profile_features(polar(spark, sf)).select("sample_id", F.posexplode("vec").alias("pos", "v")).withColumn("v", F.round("v", 6))


@query("a38_combined_vectors")
def _(spark, sf):
    rows = [px_scores.combined_vectors(polar(spark, sf), 24, 24, 3, 8, invariant=v).select("id", F.lit(v).alias("invariant"), F.posexplode("vec").alias("pos", "v"))
            for v in (False, True)]
    return rows[0].unionByName(rows[1]).withColumn("v", F.round("v", 6))


@query("a38_alternative_neighbors")
def _(spark, sf):
    vectors = search.standardised_vectors(px_scores.combined_vectors(polar(spark, sf), 24, 24, 3, 8, invariant=True), flat_as_one=True)
    return rounded(search.cosine_neighbors(vectors, vectors, K))


@query("a38_rule_scores")
def _(spark, sf):
    return rounded(px_scores.rule_scores(polar(spark, sf), 24, 24, 3, 8))


# ---- archives, text rows, inference and the remaining windows
def packed(spark, sf, damage=False):
    px = demo.pixels(spark, sf).select("sample_id", "w", "y", "x", "severity", "in_wafer", "valid", "stby", "height", "width")
    if damage:
        here = (F.col("y") == 3) & (F.col("x") == 3)
        px = px.withColumns({"severity": F.when((F.col("w") % 3 == 1) & here, 9).otherwise(F.col("severity")),
                             "stby": F.when((F.col("w") % 4 == 2) & here, 2).otherwise(F.col("stby"))})
    blocks = F.struct(F.lit(4).alias("width"), F.lit(4).alias("height")).alias("chip_blocks")
    return arrays.pack_archives(px.drop("w")).select("sample_id", "content", blocks)


@query("s02_archive_round_trip", "SELECT sample_id, y, x, severity, in_wafer, valid, stby, chip_id, d2, wafer_extent FROM cpid", ("cpid",))
def _(spark, sf):
    return arrays.read_pixels(packed(spark, sf)).select("sample_id", "y", "x", "severity", "in_wafer", "valid", "stby", "chip_id", "d2", "wafer_extent")


@query("s03_archive_errors", """SELECT DISTINCT sample_id, 'severity must be in grade range 0..7' AS error FROM px WHERE w%3=1 UNION ALL SELECT DISTINCT sample_id, 'stby_mask must be binary' FROM px WHERE w%4=2""", ("px",))
def _(spark, sf):
    return arrays.read_errors(packed(spark, sf, damage=True)).select("sample_id", F.explode("errors").alias("error"))


@query("s11_csv_rows", "SELECT o_orderkey, o_orderstatus, o_orderkey%7 AS slot FROM orders WHERE o_orderkey%5=0")
def _(spark, sf):
    k = F.col("o_orderkey")
    rows = demo.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", (k % 7).alias("slot"), F.when(k % 5 == 0, "val").otherwise("train").alias("split"))
    folder = shared_folder(spark, "csv")
    catalog_io.write_table(rows, folder, "csv")
    return catalog_io.read_csv(spark, folder, "o_orderkey long, o_orderstatus string, slot long, split string", split="val").drop("split")


@query("v08_inferred_chip_size")
def _(spark, sf):
    from siliscope.plans.review_queries import gray_pixels
    return chipsize.infer_chip_size(gray_pixels(spark, sf))


@query("w01_ranked_neighbors", "SELECT query_id, string_agg(neighbor_id, ',' ORDER BY rank) AS neighbors FROM nn GROUP BY 1", ("nn",))
def _(spark, sf):
    ordered = F.array_sort(F.collect_list(F.struct("rank", "neighbor_id")))
    return wafer_neighbors(spark, sf).groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda s: s["neighbor_id"]), ",").alias("neighbors"))


@query("w04_cumulative_minimum", "SELECT lot_id, cy, cx, round(min(p_value) OVER (PARTITION BY lot_id ORDER BY round(p_value,12) DESC, cy DESC, cx DESC ROWS UNBOUNDED PRECEDING),9) AS lowest FROM hscell", ("hscell",))
def _(spark, sf):
    from siliscope.plans.map_queries import lot_cells
    w = Window.partitionBy("lot_id").orderBy(F.round("p_value", 12).desc(), F.col("cy").desc(), F.col("cx").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return lot_cells(spark, sf).select("lot_id", "cy", "cx", F.round(F.min("p_value").over(w), 9).alias("lowest"))


@query("w05_circular_gaps", "SELECT sample_id, region, CASE WHEN count(*)<=1 THEN 0.0 ELSE round(1.0-max(gap),9) END AS span FROM (SELECT *, coalesce(lead(theta) OVER (PARTITION BY sample_id,region ORDER BY theta), min(theta) OVER (PARTITION BY sample_id,region)+1.0)-theta AS gap FROM regions) GROUP BY 1,2", ("regions",))
def _(spark, sf):
    chips = gm.by_wafer(gm.chips(demo.pixels(spark, sf), gm.Geometry(**demo.GEOMETRY)))
    hot = cmp.hot_chip_regions(gm.with_chip_polar(chips, "n_valid"))
    return hot.groupBy("sample_id", "region").agg(F.round(cmp.circular_span(F.collect_list("theta")), 9).alias("span"))


@query("w07_running_ids", "SELECT sample_id, chip_row, chip_col, row_number() OVER (PARTITION BY sample_id ORDER BY chip_row, chip_col) AS chip_no FROM chips WHERE n_wafer>0", ("chips",))
def _(spark, sf):
    chips = gm.chips(demo.pixels(spark, sf), gm.Geometry(**demo.GEOMETRY)).filter("n_wafer > 0")
    return chips.select("sample_id", "chip_row", "chip_col", F.row_number().over(Window.partitionBy("sample_id").orderBy("chip_row", "chip_col")).alias("chip_no"))


@query("l03_first_after_suppression", "SELECT sample_id, class_name, place, gy, gx FROM wins WHERE place<=2", ("wins",))
def _(spark, sf):
    from siliscope.plans.map_queries import windows
    return windows(spark, sf).filter("place <= 2").select("sample_id", "class_name", "place", "gy", "gx")
