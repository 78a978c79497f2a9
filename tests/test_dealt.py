"""Queries whose work per row is costly deal the rows of a small file to several tasks, and read each text once."""

import pytest

import __spark_entry__ as entry
from tallyloom.functions.markup import PLAIN
from tallyloom.operators import periods, ranking


@pytest.mark.parametrize("name", ["anchored_numbers", "option_labels", "tiers_splits_and_ages", "payment_plan_totals", "questions_in_bulk", "tables_of_pages", "periods_by_source", "campaign_periods"])
def test_rows_are_dealt_to_tasks(spark, sf, name):
    query = entry.queries()[name](spark, sf)._jdf.queryExecution()
    assert "REPARTITION_BY_NUM" in query.executedPlan().toString()


def test_first_of_a_group_are_cut_before_the_shuffle(spark):
    """With a limit every task passes on its first rows only: no ranges are written and nothing else is shuffled."""
    df = spark.range(1000).selectExpr("id", "'b' as bank", "if(id % 3 = 0, null, id % 7) as cashback_pct")
    out = ranking.rank_by(df, "en_yuksek_iade_orani", ["bank"], "id", limit=5)
    assert "WindowGroupLimit" in out._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.rank, r.id) for r in out.filter("rank is not null").orderBy("rank").collect()] == [(1, 13), (2, 20), (3, 34), (4, 41), (5, 55)]
    assert sorted(r.id for r in out.filter("status = 'no_data'").collect()) == [0, 3, 6, 9, 12]


def test_cells_are_parsed_once(spark, sf):
    """What several joins read of the cells is written; only the controls of tables_of_pages are still parsed in the plan."""
    parsed = {name: entry.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") for name in ("matrices_by_currency", "tables_of_pages")}
    assert parsed == {"matrices_by_currency": 0, "tables_of_pages": 1}


def test_lines_of_a_text_are_looked_at_once(spark):
    docs = spark.createDataFrame([(1, "Kampanya Dönemi\n01.02.2024 - 05.02.2024"), (2, "01.02.2024"), (3, "1 Mart 2024 - 9 Mart 2024"), (4, None)], "id long, t string")
    found = periods.campaign_period(docs, "id", "t")
    assert "posexplode" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {r.id: r.precision for r in found.collect()} == {1: "exact", 2: "unknown", 3: "exact", 4: "unknown"}


def test_attributes_of_one_word_are_plain():
    assert PLAIN.fullmatch("<input type=number name=n min=1 max=5>") and not PLAIN.match("<a b=c\"d>")
