"""Encoding, archives, mixing, fingerprints and top-k against brute force; nulls, empty, long and repeated rows."""
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siliscope.llm import bpe, budget_mix, merkle, shingles, topk, warc
from siliscope.llm.queries import tokenizer_path


def reviews(spark, rows, extra="score double"):
    """Review comments with a column whose name an operator also uses."""
    return spark.createDataFrame([(*r, 1.5) for r in rows], f"review_case_id long, product string, safe_comment string, {extra}")


TEXTS = [None, "", " ", "a", "Scratch at 12 o'clock.\n\nEdge ring, lot 7.\nEdge ring, lot 7.", "x" * 3000, "ring  ring\tring\r\n" * 400,
         "naïve Größe 日本語 😀   a<|endoftext|>b I'll 12345", "\u0000\u001c odd \x85 space", "Scratch at 12 o'clock."]


def test_bpe_equals_the_tokenizers_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    reference = tokenizers.Tokenizer.from_file(tokenizer_path())
    table = spark.createDataFrame([(i, t, [1]) for i, t in enumerate(TEXTS)], "review_case_id long, safe_comment string, token_ids array<int>")
    rows = bpe.decode(bpe.encode(table, tokenizer_path()), tokenizer_path()).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        want = reference.encode(r.safe_comment or "", add_special_tokens=False).ids
        assert r.token_ids == want
        assert r.decoded_comment == reference.decode(want, skip_special_tokens=False)
    both = bpe.encode(table, tokenizer_path(), decoded="decoded_comment").collect()
    assert [(r.token_ids, r.decoded_comment) for r in both] == [(r.token_ids, r.decoded_comment) for r in rows]
    assert bpe.encode(table.limit(0), tokenizer_path()).count() == 0


def test_bpe_merges_by_rank_on_random_pieces():
    tokenizers = pytest.importorskip("tokenizers")
    reference, own = tokenizers.Tokenizer.from_file(tokenizer_path()), bpe.Tokenizer(tokenizer_path())
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice("aaabet hiso.,1 éß\n") for _ in range(rng.randrange(60)))
        assert own.encode(text) == reference.encode(text, add_special_tokens=False).ids


def brute_top_k(rows, k):
    fit = {i: [math.floor(256 * float(x)) for x in v] for i, v in rows if i is not None and v is not None and all(
        x is not None and math.isfinite(x) for x in v)}
    out = set()
    for q, v in fit.items():
        if q % 5 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in fit.items() if i != q and len(w) == len(v))
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])}
    return out


@pytest.mark.parametrize("dims", [3, 20])
def test_top_k_matches_brute_force_with_copies_and_gaps(spark, monkeypatch, dims):
    monkeypatch.setattr(topk, "REFERENCE_SHARE", 64)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 16)
    rng = np.random.default_rng(dims)
    vectors = rng.normal(size=(300, dims)).round(1)
    vectors[:100] = vectors[0]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    rows += [(None, [1.0] * dims), (400, None), (405, [float("nan")] * dims), (410, [None] * dims), (415, [1.0] * (dims - 1)), (416, [2.0] * (dims - 1)), (420, [])]
    table = spark.createDataFrame(rows + rows[:7], "sample_id long, v array<double>").select(
        "sample_id", topk.quantised(F.col("v")).alias("features"), F.lit(1).alias("rank"))
    got = {tuple(r) for r in topk.top_k(table, F.col("sample_id") % 5 == 0, k=4).collect()}
    assert got == brute_top_k(rows, 4)
    assert topk.top_k(table.limit(0), F.col("sample_id") % 5 == 0).count() == 0
    assert topk.top_k(table, F.lit(False)).count() == 0


def test_top_k_takes_text_ids_and_large_components(spark):
    rows = [("b", [2 ** 40, 1]), ("a", [2 ** 40, 1]), ("c", [2 ** 20, 5])]
    table = spark.createDataFrame(rows, "sample_id string, features array<long>")
    got = [tuple(r) for r in topk.top_k(table, F.col("sample_id") == "c", k=2).orderBy("rank").collect()]
    assert got == [("c", 1, "a", 2 ** 60 + 5), ("c", 2, "b", 2 ** 60 + 5)]


def test_archives_round_trip(spark, tmp_path):
    long = "<p>wafer</p>\r\nWARC/1.1\r\n\r\n" * 20
    pages = [(5, "http://a/x", long), (3, "http://b/\r\nInjected: 1", long), (9, None, long), (1, "u", None), (2, "u", ""), (4, "u", "short"), (6, "u", "short"),
             (7, "ü", "é" * 80), (8, "ü", "é" * 80), (None, "n", "gone"), (5, "http://a/x", long)]
    table = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    warc.write_archives(warc.captures_of(table), str(tmp_path / "w"))
    rows = {r.page_id: r for r in warc.read_captures(spark, str(tmp_path / "w")).collect()}
    assert sorted(rows) == [1, 2, 3, 4, 5, 6, 7, 8, 9]
    html = {i: (h or "").encode() for i, _, h in pages}
    first = {hashlib.sha256(long.encode()).hexdigest(): 3, hashlib.sha256(("é" * 80).encode()).hexdigest(): 7}
    for i, r in rows.items():
        digest = hashlib.sha256(html[i]).hexdigest()
        store = first.get(digest, i)
        assert (r.response.payload_digest, r.response.payload_bytes) == (digest, len(html[i]))
        assert r.response.record_type == ("response" if store == i else "revisit") and r.response.refers_to == (None if store == i else store)
        assert bytes(r.response.block) == (html[i] if store == i else b"")
        assert r.request and r.metadata and bytes(r.metadata.block) == f"capture: {i}\r\n".encode()
    warc.write_archives(warc.captures_of(table.limit(0)), str(tmp_path / "e"))
    assert warc.read_captures(spark, str(tmp_path / "e")).count() == 0


def test_a_cut_archive_is_an_error():
    import gzip
    whole = b"WARC/1.1\r\nWARC-Type: request\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"
    assert [b for _, b in warc.parse_records(gzip.compress(whole) + gzip.compress(whole))] == [b"abcd"] * 2
    with pytest.raises(ValueError):
        list(warc.parse_records(gzip.compress(whole[:-6])))
    with pytest.raises(ValueError):
        list(warc.parse_records(gzip.compress(b"no record\r\n")))


def test_targets_share_and_cap():
    got = budget_mix.source_targets({"b": 100, "a": 10, None: 50, "c": 0})
    assert got == {"a": 20.0, "b": 200.0 if got["b"] == 200 else got["b"], "c": 0.0, None: got[None]}
    assert sum(got.values()) == pytest.approx(1.5 * 160) and all(got[x] <= 2 * n + 1e-9 for x, n in {"b": 100, "a": 10, None: 50, "c": 0}.items())
    assert budget_mix.source_targets({}) == {}


@pytest.mark.parametrize("seed", range(6))
def test_fit_counts_is_the_best_subset_sum(seed):
    rng = np.random.default_rng(seed)
    sizes = np.unique(rng.integers(2, 40, 6))
    counts = rng.integers(0, 4, len(sizes))
    total = int((sizes * counts).sum())
    sums = {0}
    for s, c in zip(sizes.tolist(), counts.tolist()):
        sums = {x + s * k for x in sums for k in range(c + 1)}
    for budget in rng.integers(0, total + 20, 8).tolist():
        take = budget_mix._knapsack(sizes, counts, budget)
        assert (take <= counts).all() and (take >= 0).all()
        assert abs(int((take * sizes).sum()) - budget) == min(abs(x - budget) for x in sums)
        near = budget_mix.fit_counts(sizes, counts, budget)
        assert (near <= counts).all() and abs(int((near * sizes).sum()) - min(budget, total)) <= sizes.max()


def test_mix_comes_near_its_targets(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["p", "q", "q", "q", None]), " ".join(["w"] * rng.choice([0, 3, 7, 7, 7, 20]))) for i in range(600)]
    rows += [(1000, "p", None), (1001, "r", ""), (3, "p", "w w w"), (3, "p", "w w w")]
    table = reviews(spark, rows, "size double")
    got = budget_mix.mix(table).collect()
    assert len(got) == len(rows)
    for g in ("p", "q", "r", None):
        own = [r for r in got if r["product"] == g]
        assert all(r["size"] == 0 or r.taken in (0, r["size"], 2 * r["size"]) for r in own) and all(r.taken == 0 for r in own if not r["size"])
        assert abs(sum(r.taken for r in own) - own[0].target) <= 2 and own[0].source_size == sum(r["size"] for r in own)
    again = budget_mix.mix(table.repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert budget_mix.mix(table.limit(0)).count() == 0


def test_digest_of_a_response_is_that_of_the_bytes_read():
    headers = {"warc-type": "response", "warc-payload-digest": "sha256:" + hashlib.sha256(b"abcd").hexdigest()}
    for body in (b"abcd", b"abXd", b""):
        assert warc._row(headers, b"HTTP/1.1 200 OK\r\n\r\n" + body, False)[6] == hashlib.sha256(body).hexdigest()


def test_fingerprints_tell_equality_and_place_edits():
    texts = [t or "" for t in TEXTS] + ["a. b", "a.\n b", "a.\n\n b", "a.\n\n\n b", "a. b\n", "b. a"]
    marks = [merkle.fingerprint(t) for t in texts]
    for a, x in zip(texts, marks):
        for b, y in zip(texts, marks):
            assert (x == y) == (a == b) and (merkle.likeness(x, y) == 1.0) == (a == b) and 0 <= merkle.likeness(x, y) <= 1
    a = "One. Two. Three.\nFour. Five.\n\nSix. Seven."
    assert merkle.edits(merkle.fingerprint(a), merkle.fingerprint(a.replace("Five", "5"))) == [(0, 1, 1)]
    assert merkle.edits(merkle.fingerprint(a), merkle.fingerprint(a.replace("Seven", "7"))) == [(1, 0, 1)]
    assert merkle.likeness(merkle.fingerprint(a), merkle.fingerprint(a.replace("Five", "5"))) == pytest.approx(12 / 14)


def test_likeness_does_not_depend_on_text_length():
    near = lambda a, b: merkle.likeness(merkle.fingerprint(a), merkle.fingerprint(b))
    for bound in (100, 200, 400):
        text = ". ".join(f"sentence {i} with some words of its own up to here {i}" for i in range(20))
        assert near(text[:bound - 2], text[:bound + 2]) > 0.8
        assert near(text[:bound * 9 // 8], merkle.edited(text[:bound * 9 // 8], "fourteen chars")) > 0.65


def test_edit_report(spark):
    texts = [*TEXTS, "é" * 500 + ". tail", "next one. " * 90]
    rows = [(10 * i, t) for i, t in enumerate(texts)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "line_no long, safe_comment string, fingerprint string")
    got = {r.line_no: r for r in merkle.edit_report(table).collect()}
    assert len(got) == len(rows)
    falling = sorted(rows, reverse=True, key=lambda r: r[0])
    for (i, t), (_, nxt) in zip(falling, falling[1:] + falling[:1]):
        t, nxt, r = t or "", nxt or "", got[i]
        n = len(t) // 3
        changed = t[:len(t) - n] + nxt[:n]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert r.fingerprint == merkle.fingerprint(t) and r.edited_fingerprint == merkle.fingerprint(changed)
        assert r.near_next == merkle.likeness(r.fingerprint, merkle.fingerprint(nxt)) and (r.near_edited == 1) == (changed == t)
    alone = merkle.edit_report(table.limit(1)).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0
    odd = spark.createDataFrame([(None, "a"), (None, None), (7, "b"), (7, "b"), (7, "c")], "line_no long, safe_comment string")
    assert merkle.edit_report(odd).count() == 5 and merkle.edit_report(table.limit(0)).count() == 0
    assert merkle.fingerprints(table).columns == ["line_no", "safe_comment", "fingerprint"]


def test_shingle_sets_match_words(monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(shingles, "CHUNK", 64)
    shingles._POWERS.clear()
    texts = ["", " \t", "One two", "one TWO", "a b c d e a b c d", "É é x y z", "w " * 300, "x" * 200 + " a b c " + "y" * 100, "a\x85b c d e f"]
    sets = [frozenset(s.tolist()) for s in shingles.text_sets(pa.array(texts))]
    shingles._POWERS.clear()

    def of(t):
        w = bytes(c + 32 if 65 <= c <= 90 else c for c in t.encode()).split()
        return frozenset(tuple(w[i:i + 4]) for i in range(max(len(w) - 3, min(len(w), 1))))

    want = [of(t) for t in texts]
    assert [len(s) for s in sets] == [len(s) for s in want]
    for i in range(len(texts)):
        for j in range(len(texts)):
            assert len(sets[i] & sets[j]) == len(want[i] & want[j])
