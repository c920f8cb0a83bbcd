"""The pipeline stage by stage against brute force, and as a whole."""
import random
from collections import Counter

import pytest
from test_models_and_joins import base_by_hand, components_by_hand, linked_by_hand

import corpus_pipeline as cp
from siliscope.llm import budget_mix
from siliscope.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(n=600, seed=8):
    rng = random.Random(seed)
    words = ["ring", "edge", "scratch", "chip", "wafer", "die", "lot", "fail", "zone", "mark", "pad", "line"]
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(words) + rng.choice(["", "s", "ed"]) for _ in range(rng.randrange(5, 60)))
        if i % 9 == 4:
            text += " moron " + text[:20] + " scum"
        if i % 7 == 3:
            text += rng.choice([" password=hunter22", " AKIA" + "Q7" * 8 + " " + "aB3" * 12, " " + "0a" * 14])
        if i % 5 == 2 and rows:
            text = rows[rng.randrange(len(rows))][1] or "x"
        rows.append((i, text, "en", rng.choice(["a", "b", "b", None]), len(text)))
    long = " ".join(rng.choice(words) for _ in range(4000))
    return [*rows, (900, None, None, "a", 0), (901, "", "en", "a", 0), (902, long, "en", "c", len(long)), (903, "lone words here", None, None, 15),
            (903, "lone words here", None, None, 15), (None, "no id at all", "en", "b", 12)]


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    rows = documents()
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(folder / "documents.parquet"))
    labels = [(i, 1, int("moron" in (t or ""))) for i, t, *_ in rows if i is not None and i < 800]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    return rows, str(folder)


def table(spark, rows):
    return spark.createDataFrame([(*r, 0.5) for r in rows], SCHEMA + ", score double")


def test_toxic_documents_go(spark, data):
    rows, folder = data
    out = cp.toxic_stage(spark, table(spark, rows), folder)
    assert out.columns == list(cp.COLUMNS)
    bad = {r for r in rows if "moron" in (r[1] or "")}
    kept = Counter(tuple(r) for r in out.collect())
    assert kept == Counter(r for r in rows if r not in bad)


def test_one_of_each_group_stays(spark, data):
    rows, folder = data
    known = [r for r in rows if r[0] is not None]
    by_hand = components_by_hand([(r[0], r[1]) for r in known], 80, 5)
    want = {r for r in known if by_hand[r[0]][1] == r[0]} | {r for r in rows if r[0] is None}
    out = cp.near_copy_stage(spark, table(spark, rows), folder)
    assert out.columns == list(cp.COLUMNS)
    assert Counter(tuple(r) for r in out.collect()) == Counter(want)


def test_secrets_are_masked(spark, data):
    rows, folder = data
    got = Counter(tuple(r) for r in cp.secret_stage(spark, table(spark, rows), folder).collect())
    want = Counter()
    for i, t, lang, source, n in rows:
        spans = linked_by_hand(t or "", base_by_hand(t or ""), 200)
        text, at = "", 0
        for a, _, e in spans:
            text, at = text + (t[at:a] + "[secret]" if a >= at else ""), max(at, e)
        want[(i, t if not spans else text + t[at:], lang, source, n if not spans else len(text + t[at:]))] += 1
    assert got == want and any("[secret]" in (r[1] or "") for r in got)


def test_mix_repeats_and_drops_documents(spark, data):
    rows, folder = data
    rows = [r for r in rows if r[0] != 903]
    out = [tuple(r) for r in cp.mix_stage(spark, table(spark, rows), folder).collect()]
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len((r[1] or "").split())
    targets = budget_mix.source_targets(dict(sizes))
    taken = Counter()
    for r in out:
        taken[r[3]] += len(r[1].split())
    times = Counter(out)
    assert set(times) <= set(rows) and max(times.values()) <= 2
    for source, target in targets.items():
        assert abs(taken[source] - target) <= 30


def test_tokens_equal_the_library(spark, data):
    tokenizers = pytest.importorskip("tokenizers")
    reference = tokenizers.Tokenizer.from_file(tokenizer_path())
    rows, folder = data
    out = cp.token_stage(spark, table(spark, rows), folder).collect()
    assert len(out) == len(rows) and all(r.round_trip and r.n_tokens == len(r.token_ids) for r in out)
    want = Counter(tuple(reference.encode(r[1] or "", add_special_tokens=False).ids) for r in rows)
    assert Counter(tuple(r.token_ids) for r in out) == want


def test_stages_in_turn(spark, data):
    rows, folder = data
    out = cp.run(spark, folder).collect()
    clean = {r[0] for r in rows if "moron" not in (r[1] or "")}
    assert out and {r.doc_id for r in out} <= clean and all(r.round_trip for r in out)
    assert [name for name, _ in cp.STAGES][0] == "toxicity" and len(cp.STAGES) == 5


def test_stages_of_an_empty_table(spark, data):
    _, folder = data
    empty = spark.createDataFrame([], SCHEMA)
    for _, stage_of in cp.STAGES:
        assert stage_of(spark, empty, folder).count() == 0
