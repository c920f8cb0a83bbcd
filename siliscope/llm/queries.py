"""Queries of this subpackage: each maps the given tables to an operator's records and its result back."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siliscope.llm import bpe, budget_mix, credential_links, lexical_search, merkle, ngram_join, page_text, recurrent_lm, site_quality, topk, toxicity, warc, whitening
from siliscope.llm.common import crc_remainder, table
from siliscope.sources.staging import shared_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            CHECKS[name] = sql.strip()
        return fn

    return wrap


def reviews_of(documents: DataFrame) -> DataFrame:
    """Documents as review comments."""
    return documents.select(F.col("doc_id").alias("review_case_id"), F.col("text").alias("safe_comment"),
                            F.col("source").alias("product"))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@query("op1_exact_top_k", """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
               WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
          FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v)),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("sample_id"), topk.quantised(F.col("embedding")).alias("features"))
    found = topk.top_k(vectors, is_query=F.col("sample_id") % 50 == 0, k=5)
    return found.select(F.col("query_sample_id").alias("query_id"), "rank", F.col("neighbor_sample_id").alias("vec_id"), "score")


@query("op2_bpe_round_trip")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    reviews = reviews_of(table(spark, sf_dir, "documents")).select("review_case_id", "safe_comment")
    decoded = bpe.encode(reviews, tokenizer_path(), decoded="decoded_comment")
    return decoded.select(
        F.col("review_case_id").alias("doc_id"), F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded_comment").cast("binary"), 256).alias("decoded_sha256"))


@query("op9_warc_captures", """
    WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
    r AS (SELECT payload_digest AS d, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY 1)
    SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
           CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN page_id > first_id THEN first_id END AS refers_to
    FROM p LEFT JOIN r ON d = payload_digest AND payload_bytes >= 100""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "archives")
    warc.write_archives(warc.captures_of(table(spark, sf_dir, "pages")), folder)
    return warc.read_captures(spark, folder, payload=False).select(
        "page_id", "response.payload_bytes", "response.payload_digest", "response.record_type", "response.refers_to")


@query("op10_budget_mix")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return budget_mix.mix(reviews_of(table(spark, sf_dir, "documents"))).select(
        F.col("review_case_id").alias("doc_id"), "size", "source_size", "target", "taken")


@query("op3_toxicity")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    reviews = reviews_of(table(spark, sf_dir, "documents")).select("review_case_id", "safe_comment")
    labels = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "review_case_id")
    model = toxicity.fit(reviews, toxicity.learning_fold(labels))
    scored = toxicity.score(reviews, model).drop("safe_comment")
    return scored.select(F.col("review_case_id").alias("doc_id"),
                         F.coalesce(crc_remainder("review_case_id", 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def _hits_sql(kind: int, pattern: str) -> str:
    """Matches of one kind with the text before each, so that starts follow from running lengths."""
    quoted = "'" + pattern.replace("'", "''") + "'"
    return (f"SELECT rid, {kind} AS kind, unnest(regexp_extract_all(t, {quoted})) AS hit, "
            f"unnest(string_split_regex(t, {quoted})[1:len(regexp_extract_all(t, {quoted}))]) AS gap, "
            f"unnest(range(len(regexp_extract_all(t, {quoted})))) AS i FROM d WHERE regexp_matches(t, {quoted})")


_ASSIGN_SQL = "'" + credential_links.ASSIGN.replace("'", "''") + "'"
_PATTERNS = (credential_links.ASSIGN, credential_links.ACCESS, credential_links.HEX, credential_links.IDENTIFIER, credential_links.MIXED,
             credential_links.ENDPOINT)
_LISTED = "string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind)"


@query("op4_credential_links", f"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
    hits AS ({' UNION ALL '.join(_hits_sql(i, p) for i, p in enumerate(_PATTERNS))}),
    placed AS (SELECT rid, kind, hit, CAST(sum(length(gap) + length(hit)) OVER (PARTITION BY rid, kind ORDER BY i) AS BIGINT) AS stop FROM hits),
    fit AS (SELECT rid, kind, stop - length(hit) AS start, stop, ['assign', 'access', 'hex', 'identifier', 'mixed', 'endpoint'][kind + 1] AS name,
              [2, 1, 2, 1, 2, 3][kind + 1] AS role FROM placed
            WHERE (kind <> 0 OR length(regexp_extract(hit, {_ASSIGN_SQL}, 2)) >= 6)
              AND (kind <> 4 OR (regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[A-Z]') AND regexp_matches(hit, '[a-z]')))),
    parts AS (SELECT * FROM fit f WHERE kind < 3 OR NOT EXISTS (
            SELECT 1 FROM fit b WHERE b.kind < 3 AND b.rid = f.rid AND b.start < f.stop AND f.start < b.stop)),
    near AS (SELECT w.rid, w.kind, w.start, max((p.role = 1)::INT) AS who, max((p.role = 2)::INT) AS proof
             FROM parts w JOIN parts p ON p.rid = w.rid AND p.role <> w.role AND abs(p.start - w.start) <= 200 WHERE w.kind >= 3 GROUP BY 1, 2, 3),
    kept AS (SELECT p.* FROM parts p LEFT JOIN near n ON n.rid = p.rid AND n.kind = p.kind AND n.start = p.start
             WHERE p.kind < 3 OR (p.role = 1 AND proof = 1) OR (p.role = 2 AND who = 1) OR (p.role = 3 AND who = 1 AND proof = 1)),
    listed AS (SELECT rid, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS b, count(*) FILTER (kind = 2) AS c,
               {_LISTED} FILTER (kind < 3) AS base, {_LISTED} AS spans FROM kept GROUP BY 1)
    SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(b, 0)::BIGINT AS n_access, coalesce(c, 0)::BIGINT AS n_hex,
           sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN listed USING (rid)""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = credential_links.find(reviews_of(table(spark, sf_dir, "documents")))
    base, spans = F.col("base_spans"), F.col("spans")
    return found.select(
        F.col("review_case_id").alias("doc_id"), *[credential_links.count_of(base, k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(credential_links.listed(base).cast("binary"), 256).alias("base_sha256"), credential_links.listed(spans).alias("spans"))


@query("op6_merkle_fingerprints")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("line_no"), F.col("text").alias("safe_comment"))
    return merkle.edit_report(reports).withColumnRenamed("line_no", "doc_id")


@query("op7_site_quality")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    reviews = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("review_case_id"), F.col("text").alias("safe_comment"), F.col("source").alias("product"),
        F.col("lang").alias("folder"))
    labels = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "review_case_id")
    scored = site_quality.classify(reviews, toxicity.learning_fold(labels))
    return scored.select(F.col("review_case_id").alias("doc_id"),
                         F.coalesce(crc_remainder("review_case_id", 3) == 1, F.lit(False)).alias("held_out"),
                         "evidence", "product_rate", "folder_rate", "score", "predicted")


@query("op8_ngram_join", r"""
    WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                           '[^\x20\x09-\x0D]+') AS w FROM documents),
    spots AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0),
    g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s FROM spots),
    n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
    p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
    l AS (SELECT x, y FROM p JOIN n u ON u.doc_id = x JOIN n v ON v.doc_id = y WHERE 100 * c >= 85 * (u.n + v.n - c)),
    e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
    r AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.doc_id WHERE r.c < e.y)
    SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.c) AS component_id
    FROM d LEFT JOIN n USING (doc_id) JOIN r USING (doc_id) GROUP BY 1""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(reviews_of(table(spark, sf_dir, "documents"))).withColumnRenamed("review_case_id", "doc_id")


@query("op5_recurrent_lm")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recurrent_lm.score(reviews_of(table(spark, sf_dir, "documents"))).withColumnRenamed("review_case_id", "doc_id")


@query("op11_page_text")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query("op13_whitened_components")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("sample_id"), whitening.quantised(F.col("embedding")).alias("features"))
    return whitening.whiten(vectors).withColumnRenamed("sample_id", "vec_id")


@query("op12_lexical_search", r"""
    WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
    c AS (SELECT count(*)::BIGINT AS all_n, sum(len(w))::BIGINT AS all_l FROM d WHERE len(w) > 0),
    q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark WHERE item_id IS NOT NULL),
    o AS (SELECT doc_id, len(w)::BIGINT AS n, unnest(w) AS t FROM d),
    f AS (SELECT doc_id, n, t, count(*)::BIGINT AS tf FROM o WHERE t IN (SELECT t FROM q) GROUP BY 1, 2, 3),
    g AS (SELECT t, floor(1000 * ln((2 * all_n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM f, c GROUP BY t, all_n),
    s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * all_n) // all_l))))::BIGINT AS score
          FROM q JOIN g USING (t) JOIN f USING (t), c GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    comments = reviews_of(table(spark, sf_dir, "documents")).select("review_case_id", "safe_comment")
    requests = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("line_no"), F.col("text").alias("safe_comment"))
    found = lexical_search.search(comments, requests)
    return found.select(F.col("line_no").alias("item_id"), "rank", F.col("review_case_id").alias("doc_id"), "score")
