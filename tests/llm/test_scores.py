"""Quality classifier (1), quality rules (6) and language identification (10)."""

from __future__ import annotations

import zlib

import numpy as np
import pytest

from strandvote.llm import language_id, quality_classifier, quality_rules
from strandvote.llm.common import table

SF = "/root/testdata/sf0.01"


def auc(score, label):
    order = np.argsort(np.argsort(score)) + 1
    up = label.sum()
    return (order[label].sum() - up * (up + 1) / 2) / (up * (len(label) - up))


@pytest.fixture(scope="module")
def scored(spark):
    return quality_classifier.op1_bradley_terry_quality(spark, SF).toPandas()


def test_held_out_quality(spark, scored):
    labels = table(spark, SF, "labels").toPandas().merge(scored, on="doc_id")
    held = labels[labels["held_out"]]
    assert len(held) > 40 and auc(held["score"].to_numpy(), held["quality"].to_numpy() == 1) > 0.97
    assert (held["predicted"] == held["quality"]).mean() > 0.93
    assert scored["score"].between(0, 1).all() and (scored["predicted"] == (scored["score"] >= 0.3)).all()
    assert (scored["held_out"] == [zlib.crc32(str(d).encode()) % 5 == 0 for d in scored["doc_id"]]).all()


def test_pairs_decide_the_order():
    rng = np.random.default_rng(0)
    f = rng.normal(size=(200, 3))
    good = f[:, 0] > -0.5
    model = quality_classifier.fit_pairs(f, good)
    assert auc(model.score(f), good) > 0.99
    assert abs((model.score(f) < quality_classifier.ACCEPT).mean() - (~good).mean()) < 0.03
    assert len(set(quality_classifier.fit_pairs(f, np.ones(200, bool)).score(f))) == 1
    quality_classifier.fit_pairs(np.zeros((0, 3)), np.zeros(0, bool))


def test_quality_of_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(4, 1), (8, 0), (4, 0), (None, 1), (5, None), (99, 1)], "doc_id long, quality int")
    model = quality_classifier.fit(odd, labels)
    rows = quality_classifier.score(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert quality_classifier.score(nothing, quality_classifier.fit(nothing, labels.limit(0))).count() == 0
    assert quality_classifier.accepted(odd, model).columns == odd.columns


@pytest.fixture(scope="module")
def judged(spark):
    return quality_rules.op6_distribution_rules(spark, SF).toPandas()


def test_rules_spare_clean_and_catch_junk(spark, judged):
    both = table(spark, SF, "labels").toPandas().merge(judged, on="doc_id")
    clean, junk = both[both["quality"] == 1], both[both["quality"] == 0]
    assert clean[clean["n_words"] >= 60]["kept"].mean() > 0.99
    assert (~junk[junk["n_words"] >= 60]["kept"]).mean() > 0.8
    assert not judged[judged["base_failed"]]["kept"].any()


def test_divergence():
    p = np.array([[0.5, 0.5, 0.0], [0.0, 0.0, 1.0]])
    q = np.array([0.5, 0.5, 0.0])
    assert quality_rules.js_distance(p, q).tolist() == [0.0, 1.0]


def test_references_count_every_document(make):
    docs = make([(i, "the cat the dog", "en") for i in range(30)] + [(99, "le chat", "fr"), (100, None, "de"), (101, "x", None)])
    ref = quality_rules.references(docs)
    assert ref.langs == ["en", "fr"]
    cells, shares = ref.words[0]
    assert sorted(shares[:-1]) == [0.25, 0.25, 0.5] and shares[-1] == 0 and len(cells) == 3


def test_rules_of_odd_rows(odd, nothing):
    rows = {r["doc_id"]: r for r in quality_rules.judge(odd, quality_rules.references(odd)).collect()}
    assert rows[1]["base_failed"] and rows[1]["n_words"] == 0 and rows[2]["n_words"] == 0 and rows[9]["word_chars"] == 5
    assert rows[5]["n_words"] == 60_000 and rows[5]["base_failed"]
    none = quality_rules.judge(odd, quality_rules.references(nothing)).collect()
    assert len(none) == odd.count() and all(r["nearest"] is None for r in none)
    assert quality_rules.judge(nothing, quality_rules.references(nothing)).count() == 0


def test_language_held_out(spark):
    got = language_id.op10_bigru_language(spark, SF).toPandas().merge(table(spark, SF, "documents").select("doc_id", "lang").toPandas(), on="doc_id")
    held = got[got["held_out"]]
    assert len(held) > 150 and (held["lang_pred"] == held["lang"]).mean() > 0.98
    assert got["score"].between(0, 1).all() and (got["agreeing"] <= got["positions"]).all()


def test_gradients_of_the_network():
    rng = np.random.default_rng(0)
    table_, u = (rng.normal(size=s).astype(np.float32) * 0.3 for s in ((256, 9), (3, 9)))
    x = rng.integers(0, 256, (6, 4))
    keep = []
    states = np.stack(list(language_id.run_direction(x, table_, u, keep)))
    weight = rng.normal(size=states.shape).astype(np.float32)
    d_table, d_u = language_id.back_direction(keep, weight, table_, u)
    loss = lambda t, v: float((np.stack(list(language_id.run_direction(x, t, v))).astype(np.float64) * weight).sum())
    for i, j in ((0, 0), (1, 4), (2, 8)):
        step = np.zeros_like(u)
        step[i, j] = 1e-2
        assert d_u[i, j] == pytest.approx((loss(table_, u + step) - loss(table_, u - step)) / 2e-2, abs=2e-2)
    row = int(x[2, 1])
    step = np.zeros_like(table_)
    step[row, 7] = 1e-2
    assert d_table[row, 7] == pytest.approx((loss(table_ + step, u) - loss(table_ - step, u)) / 2e-2, abs=2e-2)


def test_language_of_odd_rows(odd, nothing, make):
    docs = make([(i, "the and of the with that", "en") for i in range(20)] + [(i + 50, "der und die das nicht ein", "de") for i in range(20)])
    net = language_id.fit(docs)
    assert net.langs == ["de", "en"]
    rows = {r["doc_id"]: r for r in language_id.predict(odd, net).collect()}
    assert [rows[i]["lang_pred"] for i in (1, 2, 3, 8, 10)] == ["und"] * 5 and rows[9]["lang_pred"] != "und" and rows[5]["positions"] > 400_000
    assert language_id.fit(nothing) is None
    assert {r["lang_pred"] for r in language_id.predict(odd, None).collect()} == {"und"}
    assert language_id.predict(nothing, net).count() == 0
