import pytest

from aforo.operators import panel as P


def unit(codudu, states, start=1, codcon=1):
    return [
        dict(codudu=codudu, codcon=codcon, situdu=s, nuanio=2021, nummes=start + i, volfac=float(i))
        for i, s in enumerate(states)
    ]


def test_transitions_both_ways(bills):
    df = bills(*unit(1, "1122"), *unit(2, "2211"), *unit(3, "2222"), *unit(4, "121"), *unit(5, "11"))
    h = {r["codudu"]: r for r in P.unit_history(df).collect()}
    month = 2021 * 12
    assert (h[1]["mes_1to2"], h[1]["mes_2to1"], h[1]["nunca"]) == (month + 3, None, False)
    assert (h[2]["mes_1to2"], h[2]["mes_2to1"]) == (None, month + 3)
    assert h[3]["nunca"] and h[3]["mes_1to2"] is None
    assert (h[4]["mes_1to2"], h[4]["mes_2to1"]) == (month + 2, month + 3)
    assert not h[5]["nunca"]


def test_several_records_in_a_month_count_once(bills):
    df = bills(*unit(1, "1"), *unit(1, "1", 2), *unit(1, "2", 2), *unit(1, "2", 3))
    assert P.first_transition(df).first()["mes_evento"] == 2021 * 12 + 2


def test_missing_state_is_skipped_and_not_a_control(bills):
    df = bills(*unit(1, ["1", None, "2"]), *unit(2, ["2", None]))
    assert P.first_transition(df).first()["mes_evento"] == 2021 * 12 + 3
    assert P.never_treated(df).count() == 0


def test_controls_keep_the_ratio_and_the_treated_months(bills):
    rows = [r for i in range(4) for r in unit(i, "12", start=1 + i)]
    rows += [r for i in range(100, 160) for r in unit(i, "22")]
    df = bills(*rows)
    treated = P.first_transition(df)
    controls = P.sample_controls(treated, P.never_treated(df), 2)
    months = {r["mes_evento"] for r in treated.collect()}
    got = controls.collect()
    assert len(got) == 8 and len({r["codudu"] for r in got}) == 8
    assert {r["mes_evento"] for r in got} <= months
    again = P.sample_controls(treated, P.never_treated(df.repartition(7)), 2).collect()
    assert sorted(got) == sorted(again)


def test_no_treated_units(bills):
    df = bills(*unit(1, "22"))
    assert P.sample_controls(P.first_transition(df), P.never_treated(df)).count() == 0


def test_event_window_and_indicators(bills):
    df = bills(*unit(1, "1" * 8 + "2" * 4), *[r for i in range(2, 6) for r in unit(i, "2" * 12)])
    panel = P.did_panel(df)
    treated = panel.filter("treated = 1")
    assert sorted(r["t_rel"] for r in treated.collect()) == list(range(-6, 4))
    assert panel.filter("post <> cast(t_rel >= 0 as int)").count() == 0
    assert panel.filter("treated = 0").select("codudu").distinct().count() == 2


@pytest.mark.parametrize(
    "times,baseline", [([-2, -1, 0], -1), ([-2, 0, 1], 0), ([1, 2], None)]
)
def test_baseline(spark, times, baseline):
    df = spark.createDataFrame([("x", t) for t in times], "event_type string, t_rel int")
    rows = P.event_times(df).collect()
    assert {r["baseline"] for r in rows} == ({baseline} if baseline is not None else set())
    assert sorted(r["t_rel"] for r in rows) == ([t for t in times if t != baseline] if baseline is not None else [])
    assert P.baseline_of(times) == baseline


def test_did_basic_and_gap(spark):
    rows = [(-2, 1, 1.0), (-1, 1, 2.0), (0, 1, 6.0), (-2, 0, 4.0), (-1, 0, 5.0), (0, 0, 7.0)]
    df = P.with_post(spark.createDataFrame(rows, "t_rel int, treated int, volfac double"))
    assert P.did_basic(df).first()["effect"] == (6.0 - 1.5) - (7.0 - 4.5)
    gap = P.pretrend_gap(df).first()
    assert (gap["gap_mean"], gap["gap_std"], gap["n_periods"]) == (-3.0, 0.0, 2)


def test_plan_has_no_unbounded_window(bills):
    """The only window runs over unit-months, after the aggregation."""
    plan = P.unit_history(bills(*unit(1, "12")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") < plan.index("Aggregate [codcon", plan.index("Window"))


def test_both_panels_are_the_single_ones(spark, bills):
    rows = [r for i in range(1, 9) for r in unit(i, "112211"[i % 3 :] + "2")] + [r for i in range(50, 90) for r in unit(i, "2222")]
    df = bills(*rows)
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    events, did = P.both_panels(df.mapInArrow(count, df.schema))
    assert seen.value == 2 * df.count()
    for got, want in ((events, P.event_study_panel(df)), (did, P.did_panel(df))):
        assert set(got.columns) == set(want.columns)
        assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
        assert got.count() > 0
