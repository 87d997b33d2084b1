"""Held-out accuracy, the label model's estimates, and edge cases."""

import zlib

import numpy as np

from evgraph.llm import toxicity as tx

SCHEMA = "doc_id long, text string, score string"


def corpus(n=600):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(n):
        words = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 7))) for _ in range(rng.integers(5, 60))]
        bad = i % 5 == 0
        if bad:
            stem = ["idiot", "zorkwaz" + rng.choice(list("abcd")), "wupplix" + rng.choice(list("abcd"))][i % 3]
            words.insert(rng.integers(len(words)), stem)
        rows.append((i, " ".join(words), int(bad)))
    return rows


def test_held_out_accuracy_with_half_the_labels(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(None, "an idiot", ""), (9000, None, ""), (9001, "", ""), (0, rows[0][1], "")], SCHEMA)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 2 or y] + [(0, 1), (None, 1), (3, None), (77777, 1)], "doc_id long, toxic int")
    got = [(r.doc_id, r.held_out, r.score) for r in tx.score(docs, labels, least=3).collect()]
    assert len(got) == len(rows) + 4
    truth = {i: y for i, _, y in rows}
    for doc_id, held, score in got:
        assert 0 <= score <= 1
        if doc_id is not None:
            assert held == (zlib.crc32(str(doc_id).encode()) % 5 == 0)
    wrong = [i for i, _, s in got if i in truth and (s >= 0.5) != truth[i]]
    assert len(wrong) <= 6
    assert all(s < 0.5 for i, _, s in got if i in (9000, 9001))


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b", ""), (2, None, "")], SCHEMA)
    none = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert [r.score for r in tx.score(docs, none).collect()] == [0.0, 0.0]
    assert tx.score(docs.limit(0), none.limit(0)).collect() == []


def test_label_model_recovers_rates_and_shares_correlated_votes():
    rng = np.random.default_rng(1)
    y = rng.random(20_000) < 0.3
    first = np.where(y, rng.random(20_000) < 0.7, rng.random(20_000) < 0.05)
    votes = np.stack([first, first, np.where(y, rng.random(20_000) < 0.6, rng.random(20_000) < 0.1)], 1).astype(float)
    masks = (votes @ [1, 2, 4]).astype(np.int64)
    wide = tx.unpacked(masks, 3)
    both = np.stack([wide[~y].T @ wide[~y], wide[y].T @ wide[y]])
    model = tx.LabelModel(both, np.array([(~y).sum(), y.sum()], float))
    assert abs(model.share - 0.3) < 0.02 and abs(model.silence[1] - 0.3 * 0.4) < 0.02
    assert model.correlation[0, 1] > 0.9
    twice, once = model.posterior(tx.unpacked(np.array([3]), 3)), np.log(model.rates[1, 0] / model.rates[0, 0])
    alone = np.log(model.share / (1 - model.share)) + once
    assert abs(np.log(twice / (1 - twice)) - alone).max() < 0.2


def test_copies_of_one_long_text_leave_the_insults_their_inputs(spark):
    rows = corpus(900)
    rng = np.random.default_rng(4)
    long = " ".join("".join(rng.choice(list("klmnoprs"), 8)) for _ in range(700)) + " idiot"
    copied = [(i, long, 1) for i in range(5000, 5090)]
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows + copied], SCHEMA)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows + copied], "doc_id long, toxic int")
    known = labels.select("doc_id", "toxic")
    learned = docs.select("doc_id", docs.text.cast("binary").alias("text"))
    terms, bad, good = tx.associated_terms(learned, known, 3, 15.137)
    assert (bad, good) == (181, 720)
    assert not set(long.split()[:-1]) & {t for t, _, _ in terms}
    assert {"^zork", "^wupp"} < {t for t, _, _ in terms} and not {"^zorkw", "^zorkwa"} & {t for t, _, _ in terms}
    got = {r.doc_id: r.score for r in tx.score(docs, labels, least=3).collect()}
    assert sum((got[i] >= 0.5) != y for i, _, y in rows) <= 9
    assert all(got[i] >= 0.5 for i, _, _ in copied)


def test_more_ties_than_a_fixed_number_are_all_kept(spark):
    docs = [(i, " ".join(f"{'abcdefghij'[j // 100]}{'abcdefghij'[j // 10 % 10]}{'abcdefghij'[j % 10]}" for j in range(600)) if i % 2 else f"zz{'q' * (i % 7)}") for i in range(80)]
    rows = spark.createDataFrame([(i, bytearray(f"{t} {'v' * (i + 1)}".encode()), i % 2) for i, t in docs], "doc_id long, text binary, toxic int")
    terms, _, _ = tx.associated_terms(rows.select("doc_id", "text"), rows.select("doc_id", "toxic"), 5, 15.137)
    assert len([t for t, b, g in terms if (b, g) == (40, 0)]) >= 600


def test_linear_fit_equals_dense_newton():
    rng = np.random.default_rng(2)
    x = (rng.random((300, 12)) < 0.3).astype(float)
    chance = 1 / (1 + np.exp(-(x @ rng.normal(0, 1, 12))))
    weight = np.ones(300)
    w = tx.fit_linear([np.flatnonzero(r) for r in x], 12, chance, weight)
    wide = np.hstack((x, np.ones((300, 1))))
    guess = 1 / (1 + np.exp(-(wide @ w)))
    slope = wide.T @ ((guess - chance) / 300) + np.append(np.full(12, 1e-5), 1e-9) * w
    assert np.abs(slope).max() < 1e-8
