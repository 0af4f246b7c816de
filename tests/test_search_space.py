"""Draws from search spaces: bounds, repeats, grids and names."""

import pytest

from tidemill.operators import search_space as ss
from tidemill.plans.q_space import GRID, LAYERS, TREES


def owners(spark, names=("a", "b")):
    return spark.createDataFrame([(n,) for n in names], "station_id string")


def test_draws_lie_in_their_bounds_and_come_again(spark):
    first = ss.draws(owners(spark), TREES, 200, 1).toPandas().sort_values(["station_id", "draw"], ignore_index=True)
    again = ss.draws(owners(spark).repartition(3), TREES, 200, 1).toPandas().sort_values(["station_id", "draw"], ignore_index=True)
    assert first.equals(again) and len(first) == 400
    assert not first.equals(ss.draws(owners(spark), TREES, 200, 2).toPandas().sort_values(["station_id", "draw"], ignore_index=True))
    for name, d in TREES.items():
        assert d.low <= first[name].min() and first[name].max() <= d.high
    assert set(first["max_depth"]) == {3.0, 4.0, 5.0, 6.0, 7.0}  # the upper end is open
    assert 0.03 < first["learning_rate"].median() < 0.1  # the middle of the logarithms is 0.055


def test_a_grid_is_drawn_without_repeats_and_no_further_than_it_goes(spark):
    for n, want in ((16, 16), (36, 36), (99, 36)):
        got = ss.draws(owners(spark), GRID, n, 5).toPandas()
        assert len(got) == 2 * want and not got.duplicated(["station_id", *GRID]).any()
        assert sorted(got[got["station_id"] == "a"]["draw"]) == list(range(want))


def test_the_first_of_equal_draws_stays(spark):
    drawn = ss.draws(owners(spark), LAYERS, 40, 3)
    got = {(r["station_id"], r["layers"], r["depth"]): r["draw"] for r in ss.first_of_equal(drawn, ["station_id"], [*LAYERS]).collect()}
    want = {}
    for r in sorted(drawn.collect(), key=lambda r: r["draw"]):
        want.setdefault((r["station_id"], r["layers"], r["depth"]), r["draw"])
    assert got == want and len(want) < 80


def test_summaries_of_spaces():
    assert ss.summary(GRID) == ("random_without_replacement", "36") and ss.summary(LAYERS) == ss.summary(TREES) == ("random_with_replacement", "distribution_defined")


def test_odd_spaces(spark):
    for space in ({}, {"draw": [1]}, {"station_id": [1]}, {"x": []}):
        with pytest.raises(ValueError):
            ss.draws(owners(spark), space, 3, 1)
    assert ss.draws(owners(spark), TREES, 0, 1).count() == 0 and ss.draws(owners(spark, ()), TREES, 3, 1).count() == 0
    assert ss.draws(owners(spark, (None,)), {"x": [1, 2], "y": ss.Uniform(0, 1)}, 3, 1).count() == 3
