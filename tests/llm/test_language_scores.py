"""Scores of the language model: a score of p is right about p of the time."""

import numpy as np
import pytest

from heatlens.llm import language

LABELS = ("aa", "bb", "cc")


def drawn(random, rows, least, most):
    """Texts of three invented languages that share half of their words."""
    letters = np.array(list("abcdefghijklmnoprstuvz"))
    vocabulary = np.random.default_rng(1)
    words = lambda n: ["".join(vocabulary.choice(letters, vocabulary.integers(2, 8))) for _ in range(n)]
    shared, own = words(60), {label: words(60) for label in LABELS}
    for i in range(rows):
        label = LABELS[i % 3]
        pools = [(shared, own[label])[int(random.random() < 0.5)] for _ in range(random.integers(least, most))]
        yield i, " ".join(pool[random.integers(len(pool))] for pool in pools), label


@pytest.fixture(scope="module")
def model(spark):
    rows = list(drawn(np.random.default_rng(2), 1500, 20, 80))
    return language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_scores_are_calibrated_on_short_texts(model):
    assert language.TEMPERATURES[0] < model.temperature < language.TEMPERATURES[-1]
    short = list(drawn(np.random.default_rng(3), 3000, 1, language.PIECE_WORDS + 1))
    found = [model.predict(text) for _, text, _ in short]
    right = np.array([f[0] == label for f, (_, _, label) in zip(found, short)])
    scores = np.array([f[1] for f in found])
    assert abs(scores.mean() - right.mean()) < 0.05
    part = np.digitize(scores, [0.4, 0.6, 0.8, 0.95])
    gaps = [abs(scores[part == i].mean() - right[part == i].mean()) * (part == i).mean() for i in set(part)]
    assert sum(gaps) < 0.08


def test_long_texts_are_told_apart(model):
    unseen = list(drawn(np.random.default_rng(4), 300, 20, 80))
    found = [model.predict(text) for _, text, _ in unseen]
    assert np.mean([f[0] == label for f, (_, _, label) in zip(found, unseen)]) > 0.99


def test_rows_without_an_error_leave_the_grid_open(spark):
    rows = [(i, ("один два три", "alpha beta gamma")[i % 2], LABELS[i % 2]) for i in range(400)]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert language.TEMPERATURES[0] < model.temperature < language.TEMPERATURES[-1]
    label, score = model.predict("alpha beta")
    assert label == "bb" and 0.9 < score < 1


def test_one_label_and_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert language.train(empty).predict("words") == ("und", 0.0)
    one = language.train(spark.createDataFrame([(1, "words", "aa"), (2, None, "aa")], empty.schema))
    assert one.predict("words") == ("aa", 1.0) and one.predict("12") == ("und", 0.0)
    assert language.predict(empty, one).count() == 0


def test_a_piece_is_a_run_of_words():
    words = [f"w{i}" for i in range(40)]
    for place in range(1000):
        got = language.piece(" ".join(words), place).split()
        start = words.index(got[0])
        assert got == words[start : start + place % language.PIECE_WORDS + 1]
    assert language.piece(None, 3) == language.piece(" ", 4) == "" and language.piece("one", 5) == "one"
