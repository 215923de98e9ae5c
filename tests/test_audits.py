"""Audits compute what they check once."""


def test_explanation_audit_groups_flows_once(spark):
    """F16: flows were grouped for the ranks, for the sample of their ranges and for the percentiles, and checked by interpreted lambdas."""
    from tracemill import registry

    plan = registry.QUERIES["au9_explanation_audit"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan and "forall" not in plan
