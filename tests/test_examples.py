import __spark_entry__ as e


def test_categories_are_made_once(spark):
    """Before, the explode's filter and its rows each made the categories, with the fold of F1 in every use of it."""
    df = e.queries()["examples_per_category"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" in plan and "aggregate(" not in plan and "run(" not in plan
    assert df.count() > 0
