"""Who is left of a match's offenders is looked up once, however many steps ask."""

from tidewatch.plans import queries as Q


def test_survivors_are_a_table(spark, sf):
    rows, left = Q._offended(spark, sf)
    assert set(left.columns) == {"event_id", "rule", "pos", "ip"}
    plan = left._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan, plan
    assert 0 < left.count() < rows.count()
