"""Sketches within their bound, references exactly, and held-out accuracy of the content model."""

import random
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from meshwright.llm import content, percentiles

RUNS = "record_id long, load_id long, method string, status string, finished_at timestamp, pipeline_seconds double, matched_macro_f1 double, value double, metric string"


def runs(spark, rows):
    return spark.createDataFrame([(*r, 1.0, "clash") for r in rows], RUNS)


def test_rank_error_and_merging(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, 1, 60_000), rng.exponential(5, 30_000), np.full(10_000, 2.0)])
    df = spark.createDataFrame([(i % 7, float(v)) for i, v in enumerate(x)], "part int, value double").withColumn("g", F.lit("all"))
    parts = percentiles.sketches(df, ["g", "part"], 200)
    whole = percentiles.merge(parts, ["g"], 200)
    s, e = np.sort(x), percentiles.rank_error(200)
    for r in percentiles.percentiles(whole, ["g"], [1, 10, 50, 90, 99], 200, 3.0).collect():
        assert r["n"] == len(x)
        lo, hi = np.searchsorted(s, r["value"], "left") / len(s), np.searchsorted(s, r["value"], "right") / len(s)
        assert lo - 3 * e <= r["pct"] / 100 <= hi + 3 * e
        true = s[int(np.ceil(r["pct"] / 100 * len(s))) - 1]
        assert r["low"] <= true <= r["high"]


def exact(rows, reference, least=40):
    once = {}
    for i, load, method, status, t, s, f in rows:
        if status == "COMPLETED" and t is not None:
            once[i] = (method, t.strftime("%Y-%m-%d"), s, f)
    groups = {}
    for method, day, s, f in once.values():
        if s is not None and np.isfinite(s) and s >= 0:
            groups.setdefault((method, day, "pipeline_seconds"), []).append(s)
        if f is not None and 0 <= f <= 1:
            groups.setdefault((method, day, "matched_macro_f1"), []).append(f)
    out = set()
    for (m, d, k), v in groups.items():
        v.sort()
        for method, metric, pct, ref in reference:
            if (method, metric) == (m, k) and ref is not None and len(v) >= least:
                p = v[max(-(-pct * len(v) // 100) - 1, 0)]
                if (p > ref) if k == "pipeline_seconds" else (p < ref):
                    out.add((m, d, k, pct))
    return out


def test_references(spark):
    rng = random.Random(1)
    rows = []
    for i in range(3000):
        s = rng.choice([None, float("nan"), float("inf"), -1.0, 0.0, 2.0, rng.random() * 4, rng.random() * 4, rng.random() * 4])
        f = rng.choice([None, float("nan"), 1.5, -0.1, 0.5, rng.random(), rng.random()])
        t = rng.choice([None, datetime(2020, 1, 1, 23, 30) + timedelta(hours=rng.choice([0, 0, 1, 24]))])
        rows.append((i, i % 5, rng.choice(["hot", "hot", "b", "rare"]), rng.choice(["COMPLETED", "COMPLETED", " COMPLETED", None, "ERROR"]), t, s, f))
    again = [(r[0], r[1] + 5, *r[2:]) for r in rows[::3]]
    ref = [("hot", "pipeline_seconds", 50, 2.0), ("hot", "pipeline_seconds", 90, 3.3), ("hot", "pipeline_seconds", 90, 3.3), ("b", "pipeline_seconds", 50, 1.9), ("hot", "matched_macro_f1", 10, 0.1), ("b", "matched_macro_f1", 50, 0.5), ("rare", "matched_macro_f1", 50, None), ("none", "pipeline_seconds", 50, 1.0)]
    reference = spark.createDataFrame(ref, "method string, metric string, pct int, reference_value double")
    want = exact(rows, ref)
    assert want
    for k in (8, 800):  # with a coarse sketch nearly all cases go to the exact check
        got = {tuple(r) for r in percentiles.worse_than_reference(runs(spark, rows + again), reference, k).collect()}
        assert got == want
    assert percentiles.worse_than_reference(runs(spark, []), reference).count() == 0
    assert percentiles.worse_than_reference(runs(spark, rows), reference.where("false")).count() == 0


def test_normal_form_undoes_disguises():
    for shown, plain in (("h4ng y0ur53lf", "hang yourself"), ("ｇａｒｂａｇｅ", "garbage"), ("b.a.s.t.a.r.d", "bastard"), ("wіре оut", "wipe out"), ("disgusti​ng", "disgusting"), ("STUUUUPID", "stupid"), ("> f*** you", "f* you"), ("v7006 and s73", "and"), ("you/idiot", "you idiot"), ("at src/a/b.py now", "at now"), ("去/死吧 了", "去 死吧 了"), ("[scum] go", "scum go")):
        assert content.normal(shown) == plain
    assert content.passages(None) == content.passages(" \n\t") == content.passages("") == []
    long = content.passages("word " * 4000)
    assert long and all(len(p) <= 90 for p in long)


def corpus(seed, n, rate):
    rng = random.Random(seed)
    good = ["the {} stage took {} s on graph {}", "please rerun {} with {} seeds and {}", "the margin of {} is {} so {} stays", "this {} heuristic is stupid but {} beats {}", "der {} Rand schrumpft um {} bei {}"]
    bad = ["{} you are a worthless {} and should {}", "nobody would miss you if you {} in the {} {}", "halt die klappe du {} {} {}", "i want you naked on the {} {} {}"]
    words = ["sweep", "refine", "hubsplit", "cover", "loader", "merge", "river", "desk", "versager", "moron", "clown", "vanish"]
    docs = []
    for i in range(n):
        lines = [rng.choice(good).format(*(rng.choice(words[:6] + [str(rng.random())]) for _ in range(3))) for _ in range(rng.randint(1, 8))]
        toxic = rng.random() < rate
        if toxic:
            lines.insert(rng.randrange(len(lines) + 1), rng.choice(bad).format(*(rng.choice(words[6:]) for _ in range(3))))
        docs.append(("\n".join(lines), toxic))
    return docs


def test_held_out_accuracy_with_wrong_labels(spark):
    train, test = corpus(1, 1500, 0.12), corpus(2, 1200, 0.06)
    rng = random.Random(9)
    reviewed = [(i, t, y) for i, (t, y) in enumerate(train[:900])]
    labels = [(i, "none" if y == (rng.random() < 0.02) else "abuse") for i, _, y in reviewed]
    rows = [(i, t, f"s{i % 3}", "clash") for i, (t, _) in enumerate(train)] + [(10_000 + i, t, "test", "clash") for i, (t, _) in enumerate(test)]
    rows += [(90_000, None, "test", "x"), (90_001, "", None, "x"), (90_002, " \n", "test", "x"), (None, "the cover", "test", "x"), (90_003, "z" * 200_000, "test", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, score string")
    lab = spark.createDataFrame([*labels, (5, None), (None, "abuse")], "doc_id long, category string")
    s = content.scored(docs, lab)
    got = {r["doc_id"]: r for r in s.collect()}
    assert len(got) == len(rows)
    truth = {10_000 + i: y for i, (_, y) in enumerate(test)}
    hit = sum(got[i]["found"] and y for i, y in truth.items())
    said = sum(got[i]["found"] for i in truth)
    assert 2 * hit / (said + sum(truth.values())) > 0.9
    assert not any(got[i]["found"] for i in (90_000, 90_001, 90_002)) and got[90_000]["score"] == -99.0
    rates = {r["source"]: r["documents"] for r in content.source_rates(s).collect()}
    assert sum(rates.values()) == len(rows) and None in rates


def test_without_reviews(spark):
    docs = spark.createDataFrame([(1, "a text of some length", "s")], "doc_id long, text string, source string")
    assert content.scored(docs, spark.createDataFrame([], "doc_id long, category string")).where("found").count() == 0
    assert content.scored(docs.where("false"), spark.createDataFrame([], "doc_id long, category string")).count() == 0


def test_non_negative_risk_learns_from_positives_and_unlabelled():
    pos, neg = ["you are a moron", "you stupid moron", "moron you are"], ["the graph is large", "the cover is done", "graph cover large"]
    p, u = content._Bag(pos), content._Bag(neg * 3 + pos[:1])
    w, b = content.non_negative_pu(p, np.full(3, 1 / 3), u, np.full(10, 0.1), 0.1)
    m = content.Model(w, b, 0.1, np.zeros(0), np.zeros(0))
    assert m.score(["stupid moron you"])[0] > 0 > m.score(["the large graph"])[0]


def test_short_passages_are_kept():
    assert content.passages("你好。去死。") == ["你好", "去死"] and content.passages("傻逼") == ["傻逼"] and content.passages("fu") == ["fu"]
    assert content.passages("x. y. z.") == ["x", "y", "z"]


def accuracy(docs, labels, test):
    """(precision, recall) on ``test`` (text, truth) of a model fitted to (text) and (text) lists."""
    m = content.fit(labels, docs)
    s = np.array([m.document(t)[0] for t, _ in test])
    found = s > content.threshold(m.confirmed, m.others, content.cells(np.concatenate([m.others, s])))
    y = np.array([y for _, y in test])
    return (found & y).sum() / max(found.sum(), 1), (found & y).sum() / y.sum()


def test_many_bad_passages():
    """A third of all documents are cases, over 5 % of passages: the estimated share isn't held down."""
    train, test = corpus(3, 1600, 0.35), corpus(4, 800, 0.35)
    known = [t for t, y in train[:800] if y]
    precision, recall = accuracy([t for t, _ in train[800:]], known, test)
    assert precision > 0.9 and recall > 0.9
    assert content.fit(known, [t for t, _ in train[800:]]).prior > 0.02


def test_copied_cases_are_found():
    """A third of all documents are copies of one abusive text: it is confirmed, and all its copies are found."""
    train, test = corpus(5, 1200, 0.1), corpus(6, 600, 0.1)
    copy = ("the sweep took 3 s\nyou are a worthless moron and should vanish", True)
    train, test = train + [copy] * 600, test + [copy] * 300
    random.Random(1).shuffle(train)
    known = [t for t, y in train[:900] if y]
    precision, recall = accuracy([t for t, _ in train[900:]], known, test)
    assert precision > 0.9 and recall > 0.95


def test_share_of_a_mixture():
    rng = np.random.default_rng(0)
    for share in (0.01, 0.1, 0.4):
        u = np.concatenate([rng.normal(3, 1, int(20_000 * share)), rng.normal(-3, 1, int(20_000 * (1 - share)))])
        assert 0.6 * share < content.mixture_share(rng.normal(3, 1, 2000), u) < 1.3 * share


def test_sample_is_bounded_in_bytes(spark):
    docs = spark.createDataFrame([(i, "x" * 100 if i else "y" * 5000) for i in range(50)], "doc_id long, text string")
    lab = spark.createDataFrame([(i, "abuse") for i in range(20)], "doc_id long, category string")
    known, others = content.training_sample(docs, lab, most=1000)
    assert len(known) == len(others) == 10 and "0" not in known


def test_every_document_takes_part_in_the_fit(spark):
    """Shares hold each distinct text, also long ones; a fit to a bounded sample used to leave texts out."""
    docs = spark.createDataFrame([(i, "x" * (100 + i) if i else "y" * 5000) for i in range(50)] + [(100 + i, "a copy") for i in range(9)] + [(None, "no id"), (200, None)], "doc_id long, text string")
    lab = spark.createDataFrame([(i, "abuse") for i in range(20)] + [(49, "none"), (48, "abuse"), (48, "none")], "doc_id long, category string")
    rows, n = content.training_shares(docs, lab, reviewed=5, unlabelled=4, most=10**6)
    got = rows.collect()
    assert n == 8 and {r["share"] for r in got} <= set(range(n))
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert {r["text"] for r in got if r["confirmed"]} == {text[i] for i in range(20)}
    others = [(r["text"], r["n"]) for r in got if not r["confirmed"]]
    assert sorted(others) == sorted([(text[i], 1) for i in range(20, 48)] + [("a copy", 9), ("no id", 1)])


def test_mean_of_models_of_shares(spark, monkeypatch):
    """Fitted in several shares, the mean of the models finds held-out cases."""
    monkeypatch.setattr(content, "training_shares", lambda d, x, f=content.training_shares: f(d, x, 80, 300))
    train, test = corpus(7, 1500, 0.12), corpus(8, 800, 0.06)
    docs = spark.createDataFrame([(i, t, "s") for i, (t, _) in enumerate(train + test)], "doc_id long, text string, source string")
    lab = spark.createDataFrame([(i, "abuse" if y else "none") for i, (_, y) in enumerate(train[:900])], "doc_id long, category string")
    assert content.training_shares(docs, lab)[1] >= 4
    found = {r["doc_id"] for r in content.scored(docs, lab).where("found").collect()}
    truth = {len(train) + i for i, (_, y) in enumerate(test) if y}
    said = {i for i in found if i >= len(train)}
    assert 2 * len(said & truth) / (len(said) + len(truth)) > 0.9
