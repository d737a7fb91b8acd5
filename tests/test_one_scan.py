"""Summaries read each table once."""

import re

import pytest

from convolake.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name, tables", [("item_stats", 2), ("dataset_quality", 2), ("skill_overview", 6)])  # the exchanges view reads turns twice
def test_each_table_is_scanned_once(spark, name, tables):
    plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"FileScan parquet", plan)) <= tables


def test_overview_of_parts_agrees_with_the_general_form(spark):
    from convolake.operators import analytics as AN
    from convolake.operators import changes as CH
    from convolake.operators import curation as C
    from convolake.plans import views as V
    t = V.Tables(spark, SF)
    inter, ext, ad, training = V.interactions(t), V.extracted(t), V.adapters(t), V.training_data(t)
    skills = CH.distinct_ids(inter, ext, ad, key="skill_id").withColumnRenamed("skill_id", "id")
    general = AN.skill_overview(skills, C.all_training_examples(training, ext), ext, ad)
    assert sorted(map(str, general.collect())) == sorted(map(str, AN.skill_overview_of(inter, training, ext, ad).collect()))
