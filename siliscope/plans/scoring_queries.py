"""Stored-encoder queries: wafers are scored by encoders that were published, loaded again and broadcast.

The check SQL needs weights it can state, so the queries that have one publish an encoder over the full input tensor whose weights
follow from a formula; the trained encoder goes the same way in ``m05_trained_scoring`` and ``m06_trained_evaluation``.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from siliscope import constants as C
from siliscope.operators import models as md
from siliscope.operators import pooling as pl
from siliscope.operators import regions as rg
from siliscope.operators import scoring
from siliscope.plans.feature_queries import GEO
from siliscope.plans.map_queries import G, cells
from siliscope.plans.model_queries import tensor_rows
from siliscope.plans.registry import part, query
from siliscope.plans.review_queries import DIES, REAL, damaged_pixels, rule_sql
from siliscope.plans.search_queries import wafer_features
from siliscope.sources import model_store
from siliscope.sources.staging import shared_folder, stage

HIDDEN, WIDTH, CLASSES = 3, 3, len(C.REPORT_CLASSES)
INPUT = 4 * G * G
SCALED = {"w1": (7, 3, 40.0), "w2": (3, 2, 4.0), "wc": (2, 7, 2.0)}  # of the weight formula: factors of row and column, divisor


def _weight(name, r, c):
    a, b, size = SCALED[name]
    return ((r * a + c * b) % 5 - 2) / size


def formula_encoder():
    def grid(name, rows, cols):
        return np.array([[_weight(name, r, c) for c in range(cols)] for r in range(rows)])
    return md.Encoder(np.full(INPUT, 0.25), np.full(INPUT, 0.5), grid("w1", INPUT, HIDDEN), np.full(HIDDEN, 0.1), grid("w2", HIDDEN, WIDTH),
                      np.zeros(WIDTH), grid("wc", WIDTH, CLASSES), np.full(CLASSES, -0.2), C.REPORT_CLASSES)


def published(spark, model, rows):
    """Folder of a store whose only version is this encoder with the given wafers (id, vec, y) as its reference."""
    folder = shared_folder(spark, "models")
    model_store.save(spark, model, folder, md.encode(model, rows), output_size=G)
    return folder


def labelled_tensors(spark, sf):
    y = wafer_features(spark, sf).select(F.col("sample_id").alias("id"), F.array(*[F.col(f"label_{c}") for c in C.REPORT_CLASSES]).alias("y"))
    return pl.input_tensor(cells(spark, sf), G).join(y, "id")


def formula_store(spark, sf):
    return published(spark, formula_encoder(), labelled_tensors(spark, sf).filter("pmod(cast(substr(id, 2) as int), 4) <> 1"))


def six(df, names):
    return df.withColumns({n: F.round(n, 6) for n in names})


# ---- check SQL: the forward pass over the whole tensor
part("tens", "SELECT sample_id AS id, k*144 + gy*12 + gx AS i, v FROM (SELECT sample_id, gy, gx, unnest([0,1,2,3]) AS k, "
     "unnest([sev_all::DOUBLE/(7.0::DOUBLE*area), any_in_wafer::DOUBLE, any_valid::DOUBLE, any_stby::DOUBLE]) AS v FROM pool)", ("pool",))


def _sql_weight(name, r, c):
    return f"({_weight(name, r, c)!r}::DOUBLE)"


_h = ", ".join(f"tanh(sum(((v-0.25)/0.5)*(((i*7+{c * 3})%5-2)/40.0::DOUBLE))+0.1) AS h{c}" for c in range(HIDDEN))
_z = ", ".join(f"tanh({'+'.join(f'h{r}*{_sql_weight("w2", r, c)}' for r in range(HIDDEN))}) AS z{c}" for c in range(WIDTH))
_n = "greatest(sqrt(" + "+".join(f"z{c}*z{c}" for c in range(WIDTH)) + "),1e-12)"
_p = ", ".join(f"1/(1+exp(-({'+'.join(f'z{r}*{_sql_weight("wc", r, c)}' for r in range(WIDTH))}-0.2))) AS p{c}" for c in range(CLASSES))
part("tenc", f"SELECT id, {', '.join(f'z{c}/{_n} AS e{c}' for c in range(WIDTH))}, {_p} FROM (SELECT id, {_z} FROM (SELECT id, {_h} FROM tens GROUP BY 1))", ("tens",))
part("sane", f"""SELECT s.sample_id, coalesce(string_agg(e.error, '; ' ORDER BY e.o), '') AS errors FROM (SELECT DISTINCT sample_id FROM bad) s LEFT JOIN (
   SELECT r.sample_id, r.error, o.o FROM ({rule_sql(REAL, DIES)}) r JOIN (VALUES {', '.join(f"('{t}', {i})" for i, t in enumerate((
       'severity must be in grade range 0..7', 'valid must be binary', 'stby must be binary', 'severity on invalid-test pixels must be 0',
       'severity outside wafer_mask must be 0', 'stby pixels must be inside wafer_mask', 'stby pixels must have severity 0',
       'stby pixels must be invalid test pixels', 'pixels outside wafer must be invalid', 'chip_index outside wafer_mask must be -1',
       'chip_index inside wafer_mask must be non-negative', 'net die does not match chip_index die count')))}) o(t, o) ON o.t = r.error) e USING (sample_id) GROUP BY 1""", ("bad",))
_PS = ", ".join(f"p{c}" for c in range(CLASSES))
_entropy = "(" + "+".join(f"-(greatest(least(p{c},1-1e-6),1e-6)*ln(greatest(least(p{c},1-1e-6),1e-6))+(1-greatest(least(p{c},1-1e-6),1e-6))*ln(1-greatest(least(p{c},1-1e-6),1e-6)))"
                         for c in range(CLASSES)) + f")/{CLASSES}"
_NUMBERS = [*[f"prob_{n}" for n in C.REPORT_CLASSES], "top_probability", "confidence_margin", "mean_binary_entropy", *[f"embedding_{i:02d}" for i in range(WIDTH)]]


@query("m05_stored_scoring", f"""SELECT sample_id, CASE WHEN errors='' THEN 'PASS' ELSE 'FAIL' END AS status, CASE WHEN errors='' THEN 'SCORED' ELSE 'SKIPPED' END AS scoring_status, errors,
   {', '.join(f'round(p{c},6) AS prob_{n}' for c, n in enumerate(C.REPORT_CLASSES))}, top_label_hint, round(top,6) AS top_probability, round(top-second,6) AS confidence_margin,
   round(ent,6) AS mean_binary_entropy, CASE WHEN ent >= 0.60 OR top-second < 0.10 THEN 'review_high_uncertain' WHEN top >= 0.75 THEN 'review_high_strong_synthetic_match' WHEN top IS NOT NULL THEN 'review_medium' END AS review_priority,
   {', '.join(f'round(e{c},6) AS embedding_{c:02d}' for c in range(WIDTH))}
 FROM sane LEFT JOIN (SELECT *, greatest({_PS}) AS top, list_sort([{_PS}])[{CLASSES - 1}] AS second, {_entropy} AS ent,
   [{', '.join(repr(n) for n in C.REPORT_CLASSES)}][list_position([{_PS}], greatest({_PS}))] AS top_label_hint FROM tenc) t ON t.id=sample_id AND errors=''""", ("sane", "tenc"))
def _(spark, sf):
    scored = scoring.score_pixels(spark, stage(damaged_pixels(spark, sf)), GEO, formula_store(spark, sf))
    return six(scored.predictions.drop("warnings"), _NUMBERS)


@query("m05_stored_neighbors", f"""SELECT query_id, rank::INT AS rank, neighbor_id, round(1-d*d/2,6) AS similarity, {', '.join(f'label_{c} AS neighbor_has_{c}' for c in C.REPORT_CLASSES)} FROM (
   SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(d,9), neighbor_id) AS rank FROM (SELECT q.id AS query_id, r.id AS neighbor_id,
     sqrt({'+'.join(f'(q.e{c}-r.e{c})*(q.e{c}-r.e{c})' for c in range(WIDTH))}) AS d FROM tenc q JOIN sane s ON s.sample_id=q.id AND s.errors='' JOIN tenc r ON substr(r.id,2)::INT%4<>1))
   JOIN labels25 l ON l.sample_id=neighbor_id WHERE rank<=5""", ("sane", "tenc", "labels25"))
def _(spark, sf):
    scored = scoring.score_pixels(spark, stage(damaged_pixels(spark, sf)), GEO, formula_store(spark, sf))
    return six(scored.neighbors, ["similarity"])


def split_tensors(spark, sf):
    """Tensors with labels, three of ten held out by a hash of the id."""
    return stage(tensor_rows(spark, sf).withColumn("split", rg.stable_split(F.col("id"), 0.3, 11)))


def trained_on_split(spark, sf):
    rows = split_tensors(spark, sf)
    train, val = rows.filter("split = 'train'"), rows.filter("split = 'val'")
    model = md.train_encoder(md.new_encoder(train, 32, 16, C.REPORT_CLASSES), train, epochs=40, rate=0.2, pair_weight=0.5, l2=1e-4)[0]
    return model, train, val


@query("m05_trained_scoring")
def _(spark, sf):
    model, train, _ = trained_on_split(spark, sf)
    return scoring.score_pixels(spark, stage(damaged_pixels(spark, sf)), GEO, published(spark, model, train)).predictions


@query("m06_trained_evaluation")
def _(spark, sf):
    model, train, val = trained_on_split(spark, sf)
    loss, per_class, found = scoring.evaluate(model, train, val)
    part_of = lambda name, df: df.select(F.lit(name).alias("part"), "*")
    tables = [part_of("all", loss), part_of("retrieval", found), *[part_of(c, per_class.filter(F.col("class_name") == c).drop("class_name")) for c in C.REPORT_CLASSES]]
    long = None
    for table in tables:
        names = [c for c in table.columns if c != "part"]
        rows = table.select("part", *[F.col(n).cast("double").alias(n) for n in names]).unpivot(["part"], names, "metric", "value")
        long = rows if long is None else long.unionByName(rows)
    return long
