import warnings

import pytest
from helpers import config

from partita.config import Fractions, from_dict, widening


def test_refuses_bad_settings():
    for bad in (dict(resolution_max_A=0), dict(identity_threshold=0.4), dict(split_strategy="best"), dict(split_salt=""), dict(test_min_per_class={"x": 1}), dict(max_rfree=0), dict(seed=-1), dict(structural_clustering="fold")):
        with pytest.raises(ValueError):
            config(**bad)
    with pytest.raises(ValueError):
        Fractions(0.8, 0.1, 0.2)
    with pytest.raises(ValueError, match="unknown"):
        from_dict({"colour": 1})


def test_hash_ignores_descriptions_and_an_export_that_is_off():
    a = config()
    assert a.config_hash() == config(spec={"name": "x"}).config_hash() == from_dict(a.canonical()).config_hash()
    assert a.config_hash() != config(fold_benchmark_method="cath").config_hash() != config(fold_benchmark_method="ecod").config_hash()
    assert "fold_benchmark_method" not in a.canonical()


def test_values_are_normalised():
    a = config(excluded_het=("gol", "GOL"), resolution_max_A_by_method={"electron microscopy": 3.9})
    assert a.excluded_het == ("GOL",) and a.loosest_resolution == 3.9 and a.identity_level == 30 and a.dataset_version == "2026.05.30"
    assert a.resolution_cap("X-RAY DIFFRACTION") == 3.5


def test_spec_round_trip_and_warnings():
    spec = config().to_spec(name="n")
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert from_dict(spec).spec["name"] == "n"
    with pytest.warns(UserWarning, match="stamped"):
        from_dict(spec | {"split_salt": "other"})
    with pytest.warns(UserWarning, match="construction"):
        from_dict(config(structural_clustering="all", fold_benchmark_method="cath").canonical())


def test_widening():
    a = config()
    assert widening(a, a) == [] and widening(a, config(resolution_max_A=4.0)) == ["resolution_max_A"]
    assert widening(a, config(snapshot_date="2026-06-01")) == ["snapshot_date"]
