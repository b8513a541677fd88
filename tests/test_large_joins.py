"""What is exploded from a small file isn't sent whole, and a line isn't made twice to be filtered."""

import __spark_entry__
import pytest

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["epoch_reuse", "epoch_guard"])
def test_outcomes_of_epochs_are_merged(spark, name):
    text = plan(__spark_entry__.queries()[name](spark, SF))
    assert "BroadcastHashJoin" not in text and text.count("SortMergeJoin") == 2


def test_lines_are_made_once(spark):
    text = plan(__spark_entry__.queries()["obs80_parse"](spark, SF))
    assert not [x for x in text.split("\n") if "Filter" in x and "concat" in x] and "format_string" not in text
