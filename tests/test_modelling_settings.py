"""The fitting queries ask their operators for the whole job."""

import pytest

from priceforge.operators.models import DEFAULTS, SEARCH_SPACES
from priceforge.plans import QUERIES, modelling


class Asked(Exception):
    pass


def asked(monkeypatch, owner, name, query):
    """The arguments of the first call of an operator by a query, which goes no further."""
    calls = []

    def stop(*args, **settings):
        calls.append((args, settings))
        raise Asked

    class Table:
        def where(self, condition):
            return self

        drop = where

    monkeypatch.setattr(modelling, "split_table", lambda *a, **k: Table())
    Table.drop = lambda self, *names: self
    monkeypatch.setattr(modelling, "prepared", lambda *a, **k: type("P", (), {"rows": None, "names": []})())
    monkeypatch.setattr(modelling, "scratch", lambda *a: "unused")
    if name != "fold_table":
        monkeypatch.setattr(modelling.tune, "fold_table", lambda *a, **k: None)
    monkeypatch.setattr(owner, name, stop)
    with pytest.raises(Asked):
        QUERIES[query](None, "/root/testdata/sf0.001")
    return calls[0]


@pytest.mark.parametrize("query", ["select_forest", "select_rfe", "select_rfecv"])
def test_selection_forests(spark, monkeypatch, query):
    _, settings = asked(monkeypatch, modelling.select, "run_selection", query)
    assert settings.get("trees", 200) == 200 and "depth" not in settings
    assert modelling.select._forest(200, 1).depth is None
    assert settings.get("subset", "all") == "all" and settings.get("step", 10) == 10


def test_search(monkeypatch):
    args, settings = asked(monkeypatch, modelling.tune, "random_search", "random_search")
    assert args[2] == 100 and settings["folds"] == 5 and settings.get("rounds", 1.0) == 1.0 and "depth" not in settings
    args, _ = asked(monkeypatch, modelling.tune, "fold_table", "random_search")
    assert args[1] == 5


def test_sweep(monkeypatch):
    args, settings = asked(monkeypatch, modelling.tune, "sweep", "sweep")
    assert args[2] == list(SEARCH_SPACES)
    assert settings["folds"] == 5 and settings["n_trials"] == 100 and settings.get("rounds", 1.0) == 1.0


def test_single_fits(monkeypatch):
    args, settings = asked(monkeypatch, modelling.tune, "train_single", "final_fit")
    assert args[2] == DEFAULTS["RandomForest"] and settings == {"folds": 5}
    for query in ("model_catalogue", "attribution_global"):
        (_, configured), _ = asked(monkeypatch, modelling.tune, "fit_final", query)
        name = "LightGBM" if query == "model_catalogue" else "RandomForest"
        assert configured.settings.trees == DEFAULTS[name]["n_estimators"]
