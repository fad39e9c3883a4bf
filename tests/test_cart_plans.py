"""Lines of carts and search orders are shuffled as numbers, and become text behind the shuffle."""

from tallyforge.plans import queries

SF = "/root/testdata/sf0.001"


def test_lines_travel_as_numbers(spark):
    for name in ("map_cart_items", "load_results", "dq_summary", "search_order_items"):
        plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        collected = [x.split("collect_list(")[1] for x in plan.splitlines() if "collect_list(" in x]
        assert collected and all(x.startswith("struct(l_linenumber") for x in collected), name
