"""Toxicity, quality, language model, secrets and the n-gram join against brute force and held-out accuracy."""
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from siliscope.llm import credential_links as cl
from siliscope.llm import graph, ngram_join, recurrent_lm, site_quality, toxicity

COMMENT = "review_case_id long, safe_comment string"
LABELS = "review_case_id long, toxic int"


def comments(n, seed, bad=("scum", "moron"), share=0.2):
    """Review comments of invented words; a share of them has words that no other has."""
    rng = random.Random(seed)
    words = ["ring", "edge", "scratch", "chip", "wafer", "die", "lot", "fail", "zone", "mark"]
    rows, labels = [], []
    for i in range(n):
        own = [rng.choice(words) + rng.choice(["", "s", "ing"]) for _ in range(rng.randrange(3, 60))]
        toxic = rng.random() < share
        if toxic:
            for _ in range(max(1, len(own) // 12)):
                own.insert(rng.randrange(len(own) + 1), rng.choice(bad) + ",")
        rows.append((i, " ".join(own)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity_finds_held_out_comments(spark):
    rows, labels = comments(900, 1)
    rows += [(2000, None), (2001, ""), (2002, "wafer " * 20000), (2003, "Moron! " + "ring edge " * 30), (2003, "Moron! " + "ring edge " * 30)]
    table = spark.createDataFrame([(*r, 9.0) for r in rows], COMMENT + ", score double")
    marks = spark.createDataFrame([*labels, (None, 1), (5, None)], LABELS)
    model = toxicity.fit(table, toxicity.learning_fold(marks))
    got = toxicity.score(table, model).collect()
    assert len(got) == len(rows) and set(got[0].asDict()) == {"review_case_id", "safe_comment", "score", "predicted"}
    truth, held = dict(labels), [r for r in got if zlib.crc32(str(r.review_case_id).encode()) % 3 == 1 and r.review_case_id < 2000]
    assert sum(r.predicted == truth[r.review_case_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    by_id = {r.review_case_id: r for r in got}
    assert by_id[2003].predicted == 1 and not any(by_id[i].predicted for i in (2000, 2001, 2002))
    assert by_id[2000].score == by_id[2001].score


def test_toxicity_without_classes(spark):
    table = spark.createDataFrame([(1, "a b"), (2, None)], COMMENT)
    for labels, want in (([], 0.0), ([(1, 0)], 0.0), ([(1, 1)], 1.0)):
        model = toxicity.fit(table, spark.createDataFrame(labels, LABELS))
        assert [r.score for r in toxicity.score(table, model).collect()] == [want, want]
    assert toxicity.score(table.limit(0), model).count() == 0


def test_kneser_ney_shares_by_hand(spark):
    """Shares and backoff against counting in Python: all words of the sample, unknown words, and all pairs, seen once or more."""
    rows, labels = comments(120, 3)
    truth = dict(labels)
    pairs = [Counter(), Counter()]
    for i, text in rows:
        words = toxicity.WORDS.findall(text.lower())
        pairs[truth[i]].update(zip(["", *words], words))
    keys = pairs[0].keys() | pairs[1].keys()
    table, chances, ceiling = toxicity.shares(spark.createDataFrame([(h, w, pairs[0][h, w], pairs[1][h, w]) for h, w in keys], "h string, w string, n0 long, n1 long"))
    table = {r.w: r for r in table.collect()}
    d, both = toxicity.DISCOUNT, [Counter(w for h, w in p) for p in pairs]
    vocabulary, shared = sorted(both[0].keys() | both[1].keys()), sum(c.total() for c in both)
    assert [table[w].i for w in vocabulary] == list(range(1, len(vocabulary) + 1)) and table[""].i == 0
    share = [{}, {}]
    for c in (0, 1):
        for w in ["", *vocabulary]:
            base = (max(both[0][w] + both[1][w] - d, 0) + d * len(vocabulary) / (len(vocabulary) + 1)) / shared
            share[c][w] = (max(both[c][w] - d, 0) + d * len(both[c]) * base) / both[c].total()
            assert math.isclose(table[w][f"share{c}"], share[c][w])
        assert math.isclose(sum(share[c].values()), 1.0)  # unknown words included
    heads = [Counter(), Counter()]
    kinds = [Counter(), Counter()]
    for c in (0, 1):
        for (h, _), n in pairs[c].items():
            heads[c][h] += n
            kinds[c][h] += 1
    name, got = {table[w].i: w for w in vocabulary}, {}
    for r in chances.collect():
        got[name[r.i_h], name[r.i_w]] = (r.p0, r.p1)
    assert set(got) == {(h, w) for h, w in keys if h} and any(pairs[0][k] + pairs[1][k] == 1 for k in got)
    for (h, w), p in got.items():
        for c in (0, 1):
            want = share[c][w] if not heads[c][h] else max(pairs[c][h, w] - d, 0) / heads[c][h] + d * kinds[c][h] / heads[c][h] * share[c][w]
            assert math.isclose(p[c], want)
    # after any word, seen pairs and what is left for the others make one
    for c in (0, 1):
        h = max(heads[c], key=lambda x: (heads[c][x], x) if x else (0, x))
        unseen = sum(share[c][w] for w in ["", *vocabulary] if (h, w) not in got) * d * kinds[c][h] / heads[c][h]
        assert math.isclose(sum(p[c] for (g, _), p in got.items() if g == h) + unseen, 1.0)
    assert ceiling >= max(math.log(share[1][w] / share[0][w]) for w in share[0])


def test_toxicity_of_tables_with_clashing_columns(spark):
    rows, labels = comments(60, 5)
    table = spark.createDataFrame([(*r, "t", 1, 2.0) for r in rows], COMMENT + ", __text string, `a.b` int, score double")
    model = toxicity.fit(table, spark.createDataFrame(labels, LABELS))
    got = toxicity.score(table, model)
    assert got.columns == ["review_case_id", "safe_comment", "__text", "a.b", "score", "predicted"]
    assert {(r["__text"], r["a.b"]) for r in got.collect()} == {("t", 1)} and all(r.score <= 1 for r in got.collect())


def test_site_quality_shrinks_sparse_sites(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        good = rng.random() < (0.9 if i % 3 else 0.3)
        text = ". ".join(" ".join(rng.choice(["ring", "edge", "die", "zone"]) + str(rng.randrange(50)) for _ in range(9)) for _ in range(4)) \
            if good else "spam " * rng.randrange(20, 60)
        rows.append((i, "hot" if i % 3 else "cold", "f" if i % 2 else None, text))
        labels.append((i, int(good)))
    rows += [(900, "new", "x", None), (901, None, None, ""), (902, "hot", "f", "z" * 5000), (902, "hot", "f", "z" * 5000)]
    table = spark.createDataFrame([(*r, 1) for r in rows], "review_case_id long, product string, folder string, safe_comment string, evidence int")
    marks = spark.createDataFrame([(i, q) for i, q in labels if i % 4], "review_case_id long, quality int")
    got = site_quality.classify(table, marks).collect()
    assert len(got) == len(rows)
    truth = dict(labels)
    held = [r for r in got if r.review_case_id < 600 and r.review_case_id % 4 == 0]
    assert sum(r.predicted == truth[r.review_case_id] for r in held) >= 0.95 * len(held)
    by = {r.review_case_id: r for r in got}
    assert by[1].product_rate > 0.8 and by[0].product_rate < 0.5
    assert 0.3 < by[900].product_rate < 0.95  # one comment: close to the global rate
    assert site_quality.classify(table.limit(0), marks).count() == 0
    none = site_quality.classify(table, marks.limit(0)).collect()
    assert len(none) == len(rows) and all(abs(r.evidence - 0.5) < 1e-9 for r in none)


def test_strength_grows_when_groups_are_alike(spark):
    alike = spark.createDataFrame([(100.0, 50.0)] * 30, "n double, good double")
    apart = spark.createDataFrame([(100.0, 5.0), (100.0, 95.0)] * 15, "n double, good double")
    assert site_quality._strength(alike, F.lit(0.5)) > 1e5 and site_quality._strength(apart, F.lit(0.5)) < 2


def base_by_hand(x):
    kw = "(?:password|passwd|secret|token|api_?key)"
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?ai:%s)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""" % kw, x) if len(m[1]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", x) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", x) if len(m[0]) >= 24])


def linked_by_hand(x, base, window):
    def mixed(s):
        return re.search("[0-9]", s) and re.search("[A-Z]", s) and re.search("[a-z]", s)

    weak = [(m.start(), 3, m.end()) for m in re.finditer(cl.IDENTIFIER, x)]
    weak += [(m.start(), 4, m.end()) for m in re.finditer(cl.MIXED, x) if mixed(m[0])]
    weak += [(m.start(), 5, m.end()) for m in re.finditer(cl.ENDPOINT, x)]
    weak = [w for w in weak if not any(b[0] < w[2] and w[0] < b[2] for b in base)]
    role = [cl.ROLE[k] for k in cl.KINDS]
    out = []
    for w in weak:
        near = {role[p[1]] for p in base + weak if abs(p[0] - w[0]) <= window} - {role[w[1]]}
        if {1: 2 in near, 2: 1 in near, 3: {1, 2} <= near}[role[w[1]]]:
            out.append(w)
    return sorted(base + out)


def secret_texts():
    rng = random.Random(4)
    bits = ["password=hunter22", "Token: 'abc'", "API_KEY = \"0123456789\"", "secret: token : abcdefg", "AKIA" + "A1B2" * 4, "AKIA123", "ab12" * 7,
            "user_id=joe7", "clientName: acme", "https://db.example.com:9/x?y=1", "http://e.org", "Zx9" * 12, "plain words", "é" * 5, "😀",
            "\n", " " * 150, "passwd=", "apikey=====x", "ſecret=abcdefgh", "toKen=a.b-c_d"]
    fixed = ["", "password=hunter22", "AKIA" + "Z" * 16, "f" * 24, "f" * 23, "token=token=token=abcdef", "x" * 5000 + "password=1234567"]
    return fixed + ["".join(rng.choice(bits) + rng.choice([" ", "", "\n", " x "]) for _ in range(rng.randrange(1, 25))) for _ in range(120)]


def test_secrets_match_a_scan_by_hand(spark):
    texts = secret_texts()
    rows = [(i, t) for i, t in enumerate(texts)] + [(500, None), (7, texts[7]), (8, texts[9]), (None, texts[20])]
    table = spark.createDataFrame([(*r, "x") for r in rows], COMMENT + ", spans string")
    got = cl.find(table).select("review_case_id", "safe_comment", cl.listed(F.col("base_spans")).alias("b"), cl.listed(F.col("spans")).alias("s"),
                                cl.redacted(F.col("safe_comment"), F.col("spans"), "#").alias("r")).collect()
    assert len(got) == len(rows)
    want, name = {}, lambda spans: ",".join(f"{cl.KINDS[k]}:{a}:{e}" for a, k, e in spans)
    extra = 0
    for _, t in rows:
        x = t or ""
        base = base_by_hand(x)
        every = linked_by_hand(x, base, 200)
        extra += len(every) - len(base)
        text, at = "", 0
        for a, _, e in every:
            text, at = text + (x[at:a] + "#" if a >= at else ""), max(at, e)
        want[t] = (name(base), name(every), None if t is None else text + x[at:])
    assert extra > 20
    for r in got:
        assert (r.b, r.s, r.r) == want[r.safe_comment]
    assert cl.find(table.limit(0)).count() == 0


def components_by_hand(texts, percent, width):
    sets = {}
    for i, t in texts:
        w = bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()).split()
        sets[i] = frozenset(tuple(w[k:k + width]) for k in range(max(len(w) - width + 1, min(len(w), 1))))
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("percent", "width", "seed"), [(85, 4, 1), (80, 5, 2), (60, 2, 3), (100, 1, 4)])
def test_join_matches_brute_force(spark, monkeypatch, percent, width, seed):
    monkeypatch.setattr(ngram_join, "TREE_SETS", 4)
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 5)
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts, passage = [], [rng.choice(words) for _ in range(30)]
    for family in range(12):
        base = [rng.choice(words) for _ in range(rng.randrange(4, 120))]
        for _ in range(rng.choice([1, 2, 3, 25])):
            own = list(base)
            for _ in range(rng.randrange(0, 1 + len(own) // 25)):
                own[rng.randrange(len(own))] = rng.choice(words)
            if rng.random() < 0.2:
                own += passage
            texts.append(" ".join(own) if rng.random() < 0.8 else "\t".join(own).upper())
    texts += [None, "", "  ", "one", "ONE", "one two three", "w1 " * 2000, "w1 " * 2001]
    rng.shuffle(texts)
    rows = [(3 * i + 1, t) for i, t in enumerate(texts)]
    want = components_by_hand(rows, percent, width)
    table = spark.createDataFrame([(*r, 1) for r in rows + rows[:5]], COMMENT + ", n_shingles int")
    got = ngram_join.join(table, percent, width).collect()
    assert len(got) == len(rows) + 5
    assert {r.review_case_id: (r.n_shingles, r.component_id) for r in got} == want
    assert len({c for _, c in want.values()}) < len(rows)


@pytest.mark.parametrize(("percent", "width"), [(85, 4), (80, 5)])
def test_join_links_texts_with_one_word_more(spark, percent, width):
    rows = []
    for size in range(4, 61):
        for k in range(12):
            text = " ".join(f"s{size}k{k}w{i}" for i in range(size))
            rows += [(2 * len(rows), text), (2 * len(rows) + 1, text + " more")]
    want = components_by_hand(rows, percent, width)
    got = ngram_join.join(spark.createDataFrame([(*r, 1) for r in rows], COMMENT + ", n_shingles int"), percent, width).collect()
    assert {r.review_case_id: (r.n_shingles, r.component_id) for r in got} == want


def test_join_takes_the_projects_own_ids(spark):
    """Text ids, a null one, repeated ones and columns whose names clash."""
    base = " ".join(f"w{i}" for i in range(40))
    rows = [("w9__rank1__w2", base), ("w10__rank1__w2", base + " more"), ("w10__rank2__w3", "something else altogether here"), (None, base),
            ("w10__rank2__w3", "something else altogether here"), ("z", None)]
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "review_case_id string, safe_comment string, id int, number int")
    got = ngram_join.join(table)
    assert got.columns == ["review_case_id", "n_shingles", "component_id"]
    first = "w10__rank1__w2"
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [
        ("w9__rank1__w2", 37, first), (first, 38, first), ("w10__rank2__w3", 1, "w10__rank2__w3"), ("w10__rank2__w3", 1, "w10__rank2__w3"),
        (None, 37, first), ("z", 0, "z")]))


def test_first_ngrams_keep_every_link():
    for percent in (60, 80, 85, 100):
        for n in range(1, 90):
            for m in range(n, 100 * n // percent + 1):
                common = -(-percent * (n + m) // (100 + percent))
                if common > n:
                    continue
                (a, need_a), (b, need_b) = ngram_join._head(n, percent), ngram_join._head(m, percent)
                # the n-grams that only one set has come first: fewest common ones are looked at
                assert min(a - (n - common), b - (m - common)) >= max(need_a, need_b) >= 1


def test_join_of_nothing_and_of_rows_without_id(spark):
    table = spark.createDataFrame([(None, "a b c d e"), (4, "a b c d e"), (None, None)], COMMENT)
    got = sorted(((r.review_case_id or 0, r.n_shingles, r.component_id) for r in ngram_join.join(table).collect()), key=str)
    assert (0, 2, 4) in got and (4, 2, 4) in got and len(got) == 3
    assert ngram_join.join(table.limit(0)).count() == 0


def test_prefix_tree_finds_all_links():
    rng = random.Random(9)
    for _ in range(30):
        members = [(i, 0, sorted(rng.sample(range(60), rng.randrange(1, 50)))) for i in range(25)]
        members = [(i, len(g) + rng.randrange(3), g) for i, _, g in members] + [(99, 5, [1, 2, 3]), (98, 5, [1, 2, 3])]
        own = set(rng.sample(range(60), 40))
        for percent in (30, 60, 85):
            want = {i for i, n, g in members if 100 * len(own & set(g)) >= percent * (len(own) + n - len(own & set(g)))}
            assert set(ngram_join.PrefixTree(members).linked(len(own), own, percent)) == want


def test_components_of_paths_stars_and_cycles(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(500, i) for i in range(501, 560)] + [(1, 2), (2, 3), (3, 1), (7, 7), (None, 3), (9, 8), (8, 9)]
    got = {(r.node, r.component) for r in graph.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {(i, 100) for i in range(100, 141)} | {(i, 500) for i in range(500, 560)} | {(1, 1), (2, 1), (3, 1), (8, 8), (9, 8)}
    assert graph.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_language_model_counts_and_beats_them(spark):
    rng = random.Random(6)
    tongues = [["ring", "edge", "chip", "die"], ["kante", "rand", "fehler", "los"], ["bord", "puce", "lot", "zone"]]
    rows = []
    for i in range(700):
        own = rng.choice(tongues)
        rows.append((i, " ".join(rng.choice(own) + (str(rng.randrange(900)) if rng.random() < 0.3 else "") for _ in range(rng.randrange(5, 90)))))
    rows += [(1000, None), (1001, ""), (1002, "Edge " * 9000), (1003, "unseenword é\x1c"), (1004, "y" * 300 + " ring"), (5, rows[5][1]), (None, "ring ring")]
    table = spark.createDataFrame([(*r, 1) for r in rows], COMMENT + ", score int")
    got = recurrent_lm.score(table, share=2, rounds=3).collect()
    assert len(got) == len(rows)
    tokens = {i: [*(bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()).split()), None] for i, t in rows}
    counts = Counter()
    for i, _ in rows:
        if i is not None and zlib.crc32(str(i).encode()) % 10:
            counts.update(tokens[i])
    n, v = sum(counts.values()), len(counts)
    for r in got:
        own = tokens[r.review_case_id]
        base = sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in own)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(t in counts for t in own), n)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score < 0
    held = [r for r in got if r.held_out]
    assert len(held) > 40 and sum(r.score for r in held) > sum(r.base_score for r in held)
    assert recurrent_lm.score(table.limit(0)).count() == 0


def test_network_learns_from_every_training_comment(spark, monkeypatch):
    taught, lesson = [], recurrent_lm._lesson

    def noted(*args):
        out = lesson(*args)
        taught.extend(r.id for r in out.select("id").collect())
        return out

    monkeypatch.setattr(recurrent_lm, "_lesson", noted)
    recurrent_lm.score(spark.createDataFrame([(i, f"ring {i}", 1) for i in range(200)], COMMENT + ", score int"))
    assert sorted(taught) == [i for i in range(200) if zlib.crc32(str(i).encode()) % 10]
    with pytest.raises(ValueError):
        recurrent_lm.score(spark.createDataFrame([(1, "ring")], COMMENT), rounds=3, share=4)


def test_training_passes_over_every_token(monkeypatch):
    seen, learn = [], recurrent_lm.Network.learn
    monkeypatch.setattr(recurrent_lm.Network, "learn", lambda self, x, y, *rest: seen.append(y.size) or learn(self, x, y, *rest))
    for n in (1, 31, 100, 1030, 2047):
        seen.clear()
        net = recurrent_lm.Network.start(np.full(recurrent_lm.SYMBOLS, 1 / recurrent_lm.SYMBOLS))
        assert recurrent_lm.train_on(net, [np.arange(n) % recurrent_lm.SYMBOLS], 0.1) == n == sum(seen)


def test_network_gradients_and_windows():
    rng = np.random.default_rng(0)
    shares = rng.random(recurrent_lm.SYMBOLS)
    net = recurrent_lm.Network.start(shares / shares.sum())
    net.w = {k: w.astype(float) + rng.standard_normal(w.shape) * 0.2 for k, w in net.w.items()}
    x, y = rng.integers(0, recurrent_lm.SYMBOLS, (2, 5, 3))
    fresh, h = rng.random((5, 3)) < 0.2, rng.standard_normal((3, recurrent_lm.HIDDEN))
    _, _, g = net.learn(x, y, fresh, h)
    c = int(recurrent_lm.class_of(y[2, 1]))
    for name, at in (("inputs", (x[1, 1], 3)), ("inputs", (x[4, 2], 40)), ("state", (2, 7)), ("state", (5, 40)), ("state_bias", (33,)), ("classes", (1, c)),
                     ("class_bias", (c,)), ("within", (c, 4, 3)), ("within_bias", (c, 9))):
        keep, loss = net.w[name][at], []
        for d in (1e-4, -1e-4):
            net.w[name][at] = keep + d
            loss.append(net.learn(x, y, fresh, h)[0])
        net.w[name][at] = keep
        assert g[name][at] == pytest.approx((loss[0] - loss[1]) / 2e-4, abs=2e-3)
    # one step at a time gives what windows of many texts give
    texts = [rng.integers(0, recurrent_lm.SYMBOLS, n) for n in (1, 5, 70, 33, 64)]
    for s, whole in zip(texts, net.log10_of(texts)):
        h, last, total = np.zeros((1, recurrent_lm.HIDDEN)), np.array([recurrent_lm.END]), 0.0
        for t in s:
            h = net.step(last, h)
            total += net.output(h, np.array([t]))[0][0]
            last = np.array([t])
        assert whole == pytest.approx(total / math.log(10), rel=1e-4)
    # the output is a distribution
    every = np.arange(recurrent_lm.SYMBOLS)
    assert np.exp(net.output(np.repeat(h, len(every), 0), every)[0]).sum() == pytest.approx(1, rel=1e-5)
