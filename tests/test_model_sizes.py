"""The registered model queries ask for the full sizes and horizons; nothing is trained here."""

import inspect

import pytest

from delaylens.ml import classify as C
from delaylens.ml import forecast as D
from delaylens.ml import isolation as I
from delaylens.ml import ripple_models as P
from delaylens.ml import segments as G
from delaylens.plans import model_queries as Q

WANTED = {
    "logistic_delay_model": [(C, "fit_logistic", {"max_iter": 200})],
    "saved_model_scores": [(C, "fit_logistic", {"max_iter": 200})],
    "boosted_delay_model": [(C, "fit_boosted", {"params": C.FULL_SIZE["basic"]})],
    "feature_set_comparison": [(C, "compare", {"params": C.FULL_SIZE})],
    "isolation_forest_causes": [(I, "detect", {"trees": 200})],
    "isolation_forest_carrier_month": [(I, "detect", {"trees": 200})],
    "delay_model_without_anomalies": [(I, "detect", {"trees": 200}), (C, "fit_boosted", {"params": C.FULL_SIZE["predeparture"]})],
    "daily_rolling_model": [(D, "train_and_test", {"trees": 300, "depth": 30})],
    "daily_lag_model": [(D, "train_and_test", {"trees": 300, "depth": 30})],
    "lag_feature_importance": [(D, "fit", {"trees": 300, "depth": 30})],
    "overall_rolling_forecast": [(D, "fit", {"trees": 300, "depth": 30}), (D, "forecast", {"horizon": 120})],
    "daily_feature_importance": [(D, "train_and_test", {"trees": 300, "depth": 30})],
    "carrier_rolling_forecast": [(D, "fit", {"trees": 300, "depth": 30}), (D, "forecast", {"horizon": 120})],
    "carrier_lag_scenarios": [(D, "fit", {"trees": 300, "depth": 30}), (D, "forecast_scenarios", {"horizon": 30})],
    "segment_models": [(G, "fit_mean", {"trees": 300, "depth": 8}), (G, "fit_quantile", {"trees": 400, "depth": 8})],
    "ripple_model_metrics": [(P, "fit_classifier", {"size": P.Size(1500, 7)}), (P, "fit_positive", {"size": P.Size(2000, 8)})],
    "ripple_feature_importance": [(P, "fit_classifier", {"size": P.Size(1500, 7)}), (P, "fit_positive", {"size": P.Size(2000, 8)})],
}


class Anything:
    """Stands in for frames and models."""

    def __getattr__(self, name):
        return self

    def __call__(self, *args, **kwargs):
        return self

    def __iter__(self):
        return iter((self, self))

    def __getitem__(self, item):
        return self


@pytest.mark.parametrize("name", sorted(WANTED))
def test_full_sizes(monkeypatch, name):
    seen = {}
    for at in (C, D, I, P, G, Q.A, Q.E, Q.M, Q.R, Q.V, Q.X):
        for word, f in inspect.getmembers(at, inspect.isfunction):
            def record(*args, _f=f, _word=word, **kwargs):
                call = inspect.signature(_f).bind(*args, **kwargs)
                call.apply_defaults()
                seen.setdefault(_word, []).append(call.arguments)
                return Anything()

            monkeypatch.setattr(at, word, record)
    for word in ("flights", "materialize", "scratch_path", "save_model", "load_model", "found", "readings"):
        monkeypatch.setattr(Q, word, lambda *a, **k: Anything())
    monkeypatch.setattr(Q, "F", Anything())
    try:
        getattr(Q, name)(Anything())
    except (AttributeError, TypeError):  # a stand-in used as a value, after the calls of interest
        pass
    for _, word, sizes in WANTED[name]:
        assert seen.get(word), f"{word} was not called"
        for call in seen[word]:
            assert {k: call[k] for k in sizes} == sizes
    assert all(call.get("sample") is None for call in seen.get("model_frame", []))
