"""Scale guards on the physical plans of every registered query: no cross
products or nested-loop joins, no Python evaluation, no single-buffer exact
percentile, and filters on raw columns reach the parquet scan."""

import re

import pytest

from support import SF_SMALL
from wayfare.plans.catalog import all_queries
from wayfare.plans.inputs import Inputs

FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
             "percentile(", "percentile_approx("]


@pytest.fixture(scope="module")
def shared(spark):
    return Inputs(spark, SF_SMALL)


def _plan(df):
    qe = df._jdf.queryExecution()
    return qe.optimizedPlan().toString() + "\n" + qe.executedPlan().toString()


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_plan_has_no_forbidden_operators(shared, name):
    plan = _plan(all_queries()[name].build(shared))
    for op in FORBIDDEN:
        assert op not in plan, f"{name}: {op}"


def test_route_distance_filter_pushed_to_scan(spark, capsys):
    from wayfare.sources import fixtures
    capsys.readouterr()
    fixtures.form_four(spark, SF_SMALL).explain("formatted")
    out = capsys.readouterr().out
    assert "PushedFilters: [IsNotNull(l_returnflag), EqualTo(l_returnflag,R)]" in out


def test_topk_is_take_ordered(shared):
    plan = _plan(all_queries()["top5_routes_passengers"].build(shared))
    assert "TakeOrderedAndProject" in plan


def _final(plan):
    """Lines of the final adaptive plans, without the plans they replaced."""
    out, skip = [], None
    for line in plan.splitlines():
        m = re.search(r"[A-Za-z=*]", line)
        at = m.start() if m else 0
        if skip is not None:
            if at > skip or (at == skip and "== Final Plan" not in line):
                continue
            skip = None
        if "== Initial Plan ==" in line:
            skip = at
            continue
        out.append(line)
    return out


@pytest.mark.parametrize("name,reads", [
    ("kpi_summary", 3),             # facts, form_four, date bounds
    ("route_efficiency", 3),        # the largest km comes from the same pass
    ("kpi_optimization", 3),
    ("page_domains", 1),            # all lists and bounds of a page
    ("service_moments", 1),
    ("overall_moments", 1),
    ("dow_service_map", 1),
    ("daily_revenue_filled", 2),    # facts, date bounds
    ("epkm_trend_daily", 1),
    ("monthly_passengers", 1),
])
def test_registered_plans_read_the_facts_rarely(spark, name, reads):
    import __spark_entry__ as E
    tracker, group = spark.sparkContext.statusTracker(), f"build-{name}"
    spark.sparkContext.setJobGroup(group, name)
    df = E.queries()[name](spark, SF_SMALL)
    assert list(tracker.getJobIdsForGroup(group)) == [], "building the plan runs no job"
    df.collect()
    lines = _final(df._jdf.queryExecution().executedPlan().toString())
    assert sum("FileScan" in x and "[l_" in x for x in lines) == reads
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.fixture(scope="module")
def fact_tables(spark, tmp_path_factory):
    """2,000 lines, 500 orders, 4,000 customers, 40 suppliers; customers are too large to broadcast below."""
    d = str(tmp_path_factory.mktemp("facts"))
    made = {
        "lineitem": "id % 500 AS l_orderkey, id % 90 AS l_partkey, id % 40 AS l_suppkey, cast(id % 7 AS int) AS l_linenumber, "
                    "cast(id % 50 AS double) AS l_quantity, id * 1.5D AS l_extendedprice, (id % 11) / 100D AS l_discount, "
                    "(id % 9) / 100D AS l_tax, if(id % 3 = 0, 'R', 'N') AS l_returnflag, 'O' AS l_linestatus, "
                    "cast(timestamp_ntz'1997-12-01 10:00:00' + make_dt_interval(cast(id % 60 AS int)) AS timestamp_ntz) AS l_shipdate",
        "orders": "id AS o_orderkey, id * 8 AS o_custkey, 'O' AS o_orderstatus, 1D AS o_totalprice, "
                  "timestamp_ntz'1997-12-01 00:00:00' AS o_orderdate, 'x' AS o_orderpriority",
        "customer": "id AS c_custkey, sha2(cast(id AS string), 512) AS c_name, cast(id % 25 AS int) AS c_nationkey, "
                    "1D AS c_acctbal, 'm' AS c_mktsegment",
        "supplier": "id AS s_suppkey, cast(id AS string) AS s_name, cast(id % 25 AS int) AS s_nationkey, 1D AS s_acctbal",
        "nation": "cast(id AS int) AS n_nationkey, concat('N', id) AS n_name, cast(id % 5 AS int) AS n_regionkey",
        "region": "cast(id AS int) AS r_regionkey, concat('R', id) AS r_name",
    }
    for name, rows in zip(made, (2000, 500, 4000, 40, 25, 5)):
        spark.sql(f"SELECT {made[name]} FROM range({rows})").write.parquet(f"{d}/{name}.parquet")
    return d


@pytest.fixture()
def small_broadcasts(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "12000")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def _exchanges(df):
    return re.findall(r"Exchange hashpartitioning\((\w+?)#", df._jdf.queryExecution().executedPlan().toString())


def test_facts_are_shuffled_on_the_order_only(spark, fact_tables, small_broadcasts):
    from wayfare.sources import fixtures
    tickets = fixtures.tickets(spark, fact_tables)
    assert sorted(_exchanges(tickets)) == ["l_orderkey", "o_orderkey"]
    assert tickets.count() == 2000
    assert _exchanges(fixtures.trips(spark, fact_tables)) == []


def test_names_are_looked_up_after_the_distances(spark, fact_tables, small_broadcasts):
    inp = Inputs(spark, fact_tables)
    lines = inp.enriched._jdf.queryExecution().executedPlan().toString().splitlines()
    shuffled = [below for line, below in zip(lines, lines[1:]) if "Exchange hashpartitioning(schedule_no" in line]
    facts = [x for x in shuffled if "px_count" in x]
    assert len(facts) == 1 and not re.search(r"\b(ticket_type|service_type)#", facts[0])
    assert inp.enriched.columns[-5:] == ["ticket_type", "service_type", "ticket_datetime", "revenue_per_km", "passengers_per_km"]
