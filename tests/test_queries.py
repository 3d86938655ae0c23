"""Every registered query against its DuckDB statement; the others must at least give rows."""

import duckdb
import pytest

from skeinlake import plans
from tests.oracle import assert_same, connect

#: The scale that results are judged at.
SF = "/root/testdata/sf0.01"
QUERIES, ORACLES = plans.queries(), plans.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_oracle(spark, duck, name):
    assert_same(QUERIES[name](spark, SF), duck, ORACLES[name])


def test_voice_scores_of_odd_texts(spark, tmp_path):
    """Letters that end an ASCII word, other spaces, nulls, and rules that the SQL doesn't name."""
    texts = [
        "Doesí la", "doesí", "ſo what", "Oh, no", "oh_no", "ehhé", "\u00a0ok then\u3000", "\t ok", None, "", " ", "THIS IS ALL IN CAPITALS?", "Implement lane A exactly. Repo: x, your brief",
        "# a\n# b\n" + "- item\n" * 50, "Fix " + "é" * 296, "\u2003" * 9 + "x" * 279, "x" * 801, "What?" + " " * 300,
    ]
    rows = [(i, 0, "user", t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert_same(QUERIES["voice_scores"](spark, str(tmp_path)), duck, ORACLES["voice_scores"])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_nothing_else_imports_llm():
    from pathlib import Path

    import skeinlake

    for path in Path(skeinlake.__file__).parent.rglob("*.py"):
        if "llm" not in path.parts:
            assert "skeinlake.llm" not in path.read_text(), path


def test_plans_push_down_and_stay_equi(spark):
    """The selective filter reaches the scan, and no join is a cartesian product."""
    plan = QUERIES["inner_multi_key"](spark, SF)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(l_returnflag), EqualTo(l_returnflag,R)" in plan
    assert "CartesianProduct" not in plan and "l_comment" not in plan
    plan = QUERIES["order_price_percentile"](spark, SF)._jdf.queryExecution().toString()
    assert "o_comment" not in plan.split("== Physical Plan ==")[1]
