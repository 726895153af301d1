"""Exact tests with missing draws, intervals, and the gate before a verdict."""

from fractions import Fraction
from itertools import combinations, product

import duckdb
import pytest

from ctxloom.operators import exact
from ctxloom.plans import more_queries as queries
from ctxloom.plans import pipelines
from ctxloom.plans.views import TABLES
from tests.test_queries import rows

FOLDER = "/root/testdata/sf0.01"


def p_of(left, right):
    pooled = [*left, *right]
    sums = [sum(pooled[i] for i in chosen) for chosen in combinations(range(len(pooled)), len(left))]
    return Fraction(sum(s >= sum(left) for s in sums), len(sums))


@pytest.mark.parametrize("name", ["n2_permutation_p", "n2_completed_p", "n3_difference_interval", "n3_resampled_means", "p11_families", "p11_replication"])
def test_statistics_equal_sql_on_more_rows(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    assert rows(queries.QUERIES[name](spark, FOLDER).toArrow()) == rows(con.execute(queries.ORACLES[name]).to_arrow_table())


def test_an_interval_takes_few_shuffles(spark):
    plan = queries.QUERIES["n3_difference_interval"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 6


def test_the_test_queries_have_families_of_every_kind(spark):
    found = queries.QUERIES["p11_families"](spark, FOLDER)
    counts = found.selectExpr("count_if(passes)", "count_if(not passes)", "count_if(rejected and not material_pass)", "count_if(observed_p_stale < p_stale)", "count_if(critical)", "count_if(p is null)").first()
    assert all(n > 0 for n in counts[:5]) and counts[5] == 0
    assert {r["verdict"] for r in queries.QUERIES["p11_replication"](spark, FOLDER).select("verdict").distinct().collect()} == {"continue", "narrow", "stop_or_redesign_once", "invalid_execution"}


def test_a_missing_comparator_has_the_largest_p(spark):
    values = [("g", True, 80)] * 5 + [("g", False, 0)] * 4
    planned = spark.createDataFrame([(g, side, 5) for g in "gh" for side in (True, False)], "g string, treated boolean, planned int")
    found = {r["g"]: r for r in exact.completed_p(spark.createDataFrame(values, "g string, treated boolean, score long"), ["g"], planned, 100).collect()}
    assert found["g"]["observed_p"] == pytest.approx(1 / 126) and found["g"]["p"] == pytest.approx(1 / 42)
    assert (found["h"]["observed_p"], found["h"]["p"]) == (None, 1.0)


def test_ends_of_the_scale_give_the_largest_p_of_all():
    grid = (0, 1, 2)
    for a, b, c, d in product(grid, repeat=4):
        observed, p = exact.completed_choice([a, b], [c, d], 3, 3, 2)
        assert observed == float(p_of([a, b], [c, d]))
        assert p == float(max(p_of([a, b, x], [c, d, y]) for x in grid for y in grid))


def test_more_draws_than_planned_or_scores_off_the_scale_are_errors():
    for bad in (([1, 1], [0], 1, 1, 1), ([2], [0], 1, 1, 1), ([1], [-1], 1, 1, 1)):
        with pytest.raises(ValueError):
            exact.completed_choice(*bad)


def test_intervals_of_all_resamples():
    for left, right in (([0, 1], [0, 0]), ([3, 7, 8], [1, 2, 6, 6]), ([5], [5]), ([-2, 4], [10])):
        every = sorted(Fraction(sum(a), len(left)) - Fraction(sum(b), len(right)) for a in product(left, repeat=len(left)) for b in product(right, repeat=len(right)))
        for p, found in zip((25, 500, 975), exact.interval(left, right, (0.025, 0.5, 0.975)), strict=True):
            assert found == pytest.approx(float(every[max(1, -(-p * len(every) // 1000)) - 1]))


ARMS = ("correct", "withheld", "stale")


def trial(spark, missing=(), low=(), critical=(), passing=3):
    """45 units of three families, whose correct arm has all points and the others none."""
    ids = [(f"{f}-{arm}-{k}", f, arm) for f in range(3) for arm in ARMS for k in range(5)]
    units = spark.createDataFrame([(u, u, f, arm, u not in missing) for u, f, arm in ids], "unit_id string, alias string, family int, arm string, valid boolean")
    marks = spark.createDataFrame([(u, 1, "met" if arm == "correct" and f < passing and u not in low else "not_met", u in critical) for u, f, arm in ids], "alias string, criterion_id int, status string, critical boolean")
    return marks, spark.createDataFrame([(1, 1.0)], "criterion_id int, weight double"), units


@pytest.mark.parametrize(("missing", "verdict"), [
    ((), "continue"),
    (("0-correct-0", "0-withheld-0", "1-correct-0"), "narrow"),
    (("0-withheld-0", "1-withheld-0", "2-withheld-0"), "stop_or_redesign_once"),  # valid, but no p is small enough
    (("0-correct-0", "0-withheld-0", "0-stale-0", "1-correct-0"), "invalid_execution"),  # 41 of 45
    (("2-stale-0", "2-stale-1"), "invalid_execution"),  # three of five in a cell
])
@pytest.mark.parametrize("planned", [5, None])
def test_a_gate_before_the_verdict(spark, missing, verdict, planned):
    found = pipelines.replication(*trial(spark, missing), planned=planned).first()
    assert found["verdict"] == verdict and found["execution_valid"] == (verdict != "invalid_execution")
    if verdict == "invalid_execution":
        assert found["passing"] is None and found["safety_stop"] is None


@pytest.mark.parametrize(("passing", "verdict"), [(3, "continue"), (2, "continue"), (1, "narrow"), (0, "stop_or_redesign_once")])
def test_verdicts_of_complete_trials(spark, passing, verdict):
    found = pipelines.replication(*trial(spark, passing=passing)).first()
    assert (found["verdict"], found["passing"], found["safety_stop"]) == (verdict, passing, False)


def test_a_critical_finding_of_a_correct_unit_stops(spark):
    assert pipelines.replication(*trial(spark, critical=("1-correct-2",))).first()["verdict"] == "stop_or_redesign_once"
    assert pipelines.replication(*trial(spark, critical=("1-stale-2",))).first()["verdict"] == "continue"


def test_holm_takes_the_conservative_p(spark):
    low = ("1-correct-0", "2-correct-0")
    found = pipelines.replication_families(*trial(spark, missing=("0-withheld-0",), low=low)).orderBy("family").collect()
    assert found[0]["observed_p_withheld"] == pytest.approx(1 / 126)
    assert [r["p"] for r in found] == pytest.approx([1 / 42] * 3) and not any(r["rejected"] or r["passes"] for r in found)


def test_a_family_without_a_comparator_never_passes(spark):
    marks, weights, units = trial(spark, missing=tuple(f"0-stale-{k}" for k in range(5)))
    found = pipelines.replication_families(marks, weights, units).orderBy("family").collect()
    assert found[0]["p_stale"] == found[0]["p"] == 1.0 and found[0]["low_stale"] is None and not found[0]["passes"]
    gone = pipelines.replication_families(marks, weights, units.where("family > 0 or arm <> 'stale'"), planned=None).orderBy("family").collect()
    assert gone[0]["p"] == 1.0 and not gone[0]["passes"] and gone[1]["passes"]


def test_groups_of_the_same_scores_are_computed_once():
    exact._compared.cache_clear()
    some = [exact.compared(left, [1, 0, 2], 4, 3, 2) for left in ([2, 0, 1], [1, 2, 0], [0, 1, 2])]
    assert len(set(some)) == 1 and exact._compared.cache_info().misses == 1
    assert some[0] == (*exact.completed_choice([2, 0, 1], [1, 0, 2], 4, 3, 2), *exact.interval([2, 0, 1], [1, 0, 2]))
    assert exact.compared([], [1], 1, 1, 2) == (None, float(p_of([0], [1])), None, None)


def test_arms_are_joined_with_their_aliases_once(spark):
    """The figures of a family come from a table without aliases, and are shuffled from there."""
    for name in ("p11_families", "p11_replication"):
        plan = queries.QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
        assert "l_extendedprice" not in plan
