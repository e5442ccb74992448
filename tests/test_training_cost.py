"""Fits do no work that their query does not use, and no statistic twice."""

import random
import threading

import pytest

from tavola.operators import train as T
from tavola.plans import queries_ml as Q
from tavola.plans import venue
from tavola.sources import io


def _rows(spark):
    rng = random.Random(3)
    return spark.createDataFrame([(f"r{i}", "c", "l", t, float(rng.random()), float(i % 5), int(i % 3 == 0), int(i % 4 == 0))
                                  for i in range(120) for t in ("high_rated", "popular", "premium")],
                                 "restaurant_name string, city string, location string, task string, a double, b double, label int, is_test int")


def test_reference_queries_fit_only_their_own_models(spark, monkeypatch):
    df, fits = _rows(spark), []
    monkeypatch.setattr(venue, "task_data", lambda *_: df)
    monkeypatch.setattr(venue, "task_feature_sets", lambda _d: {t: ["a", "b"] for t in ("high_rated", "popular", "premium")})
    fit = T.fit
    monkeypatch.setattr(T, "fit", lambda train, fs, m, p, **how: fits.append((m, p)) or fit(train, fs, m, p, **how))
    rows = Q.q_coefficient_importance(spark, "own-models").collect()
    assert len(rows) == 6 and fits == [("logistic", "baseline")] * 3
    assert Q._reference_scores("logistic", "baseline")(spark, "own-models").count() == 90
    assert len(fits) == 3  # fitted once


def test_forests_cache_node_ids():
    assert T._classifier("random_forest", "advanced").getCacheNodeIds()


def test_inputs_are_learned_once_for_all_models_of_a_task(spark, monkeypatch, tmp_path):
    df, calls, learn = _rows(spark).where("task = 'popular'"), [], T.learn_inputs
    monkeypatch.setattr(T, "learn_inputs", lambda *a: calls.append(1) or learn(*a))
    sets, keys = {"popular": ["a", "b"]}, ["restaurant_name", "city", "location"]
    _f, scored = T.train_grid(df, sets, ("logistic", "random_forest"), keys)
    assert scored.count() == 60 and len(calls) == 1
    folded = df.selectExpr("*", "int(b) % 2 AS fold").drop("is_test")
    T.cross_validation_scores(folded, sets, ("logistic", "random_forest"), keys, str(tmp_path), k=2)
    assert len(calls) == 1 + 2


def test_stored_rows_fill_files_per_task(spark, tmp_path):
    df = _rows(spark)  # 120 rows of each of three tasks
    stored = T.store_rows(df, str(tmp_path / "rows"), "task", rows_per_file=120)
    assert stored.count() == 360 and len(list((tmp_path / "rows").rglob("*.parquet"))) == 3


def test_reference_fits_and_what_they_learn_run_side_by_side(spark, monkeypatch):
    df, kinds = _rows(spark), Q.REFERENCE["quick"]
    monkeypatch.setattr(venue, "task_data", lambda *_: df)
    monkeypatch.setattr(venue, "task_feature_sets", lambda _d: {t: ["a", "b"] for t in ("high_rated", "popular", "premium")})
    learning, fitting = threading.Barrier(3), threading.Barrier(3 * len(kinds))
    monkeypatch.setattr(T, "learn_inputs", lambda *_: learning.wait(60) < 3 and (1, {}, {}))
    monkeypatch.setattr(T, "fit", lambda *_a, **_k: fitting.wait(60))
    fitted, _rows_, _sets = Q._reference(spark, "side-by-side", kinds)
    assert len(fitted) == 9 and len(set(fitted.values())) == 9


class _Reached(Exception):
    pass


def test_serving_fits_run_side_by_side(spark, monkeypatch):
    df, models = _rows(spark), {}
    together = threading.Barrier(3)
    monkeypatch.setattr(Q, "_task_train", lambda _s, _sf, t: df.where(f"task = '{t}'"))
    monkeypatch.setattr(T, "fit_for_requests", lambda *_: together.wait(60))
    monkeypatch.setattr(io, "load_model", lambda path: path)
    monkeypatch.setattr(Q, "raw_requests", lambda *_: None)
    monkeypatch.setattr(Q.SV, "score_requests", lambda *_: None)
    monkeypatch.setattr(io, "save_model", lambda model, path: models.update({path: model}))
    served = Q.request_models(spark, "side-by-side")
    assert list(served) == ["high_rated", "popular", "premium"] and set(served.values()) == set(models)

    def fit(*_a, **_k):
        together.wait(60)
        raise _Reached
    monkeypatch.setattr(T, "fit", fit)
    with pytest.raises(_Reached):
        Q.q_serving_pipeline(spark, "side-by-side")
