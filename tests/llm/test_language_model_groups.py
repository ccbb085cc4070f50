"""The language model's classes in groups: shares, rows that a step touches, and memory of a score."""

import tracemalloc

import numpy as np

from auditframe.llm import langmodel


def _model(classes):
    unigram = np.arange(classes, 0, -1) / (classes * (classes + 1) / 2)
    return langmodel.LogBilinear.start(unigram), unigram


def test_a_class_has_its_share_of_its_group():
    model, _ = _model(53)
    before = np.tile([[5, 0, 52, 17]], (53, 1))
    p = np.exp(model.log_probabilities(before, np.arange(53)))
    assert abs(p.sum() - 1) < 1e-5
    shares = np.exp(model.predicted(before[:1]) @ model.group.T + model.group_bias)[0]
    assert np.allclose(np.add.reduceat(p, langmodel.group_starts(53)), shares / shares.sum(), rtol=1e-4)
    assert len(model.log_probabilities(before[:0], np.arange(0))) == 0


def test_a_score_holds_no_row_of_all_classes_for_each_position():
    model, _ = _model(10_000)
    rng = np.random.default_rng(3)
    before, target = rng.integers(0, 10_000, (2_000, langmodel.CONTEXT)), rng.integers(0, 10_000, 2_000)
    tracemalloc.start()
    model.log_probabilities(before, target)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2_000 * 10_000  # bytes; a number for each class of each position takes four times that


def test_a_step_moves_the_rows_that_a_dense_step_moves():
    model, unigram = _model(400)
    rng = np.random.default_rng(4)
    before, target = rng.integers(0, 30, (64, langmodel.CONTEXT)), rng.integers(0, 30, 64)
    trainer = langmodel.Trainer(model, unigram, 0)
    trainer.step(before, target)
    moved = np.flatnonzero((trainer.m.context != model.context).any(1))
    assert np.array_equal(moved, np.unique(before))
    draws = np.searchsorted(np.cumsum(unigram), np.random.default_rng(0).random(langmodel.NOISE))
    assert np.array_equal(np.flatnonzero(trainer.m.bias != model.bias), np.union1d(target, draws))


def test_rows_are_summed_by_place():
    rng = np.random.default_rng(5)
    for most in (9, 70_000):
        rows, places = rng.random((500, 3)).astype(np.float32), rng.integers(0, most, 500)
        want = np.zeros((most, 3))
        np.add.at(want, places, rows)
        at, got = langmodel.summed_rows(rows, places)
        assert np.array_equal(at, np.unique(places)) and np.allclose(want[at], got, atol=1e-4)
