"""Looking at physical plans: what reaches the scan, how often data moves, what leaves generated code."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def plan_text(df: DataFrame) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def plan_facts(df: DataFrame) -> dict[str, object]:
    """Counts of exchanges, joins and Python nodes of the plan, and the columns and filters of its scans."""
    text = plan_text(df)
    head = text.split("\n\n")[0]
    return {
        "exchanges": len(re.findall(r"(?<!Broadcast)Exchange(?! \(reused)", head)),
        "broadcasts": head.count("BroadcastExchange"),
        "nested_loops": head.count("BroadcastNestedLoopJoin"),
        "cartesian": head.count("CartesianProduct"),
        "python": len(re.findall(r"ArrowEvalPython|MapIn|FlatMapGroupsIn|BatchEvalPython", head)),
        "read_schemas": re.findall(r"ReadSchema: (.*)", text),
        "pushed": re.findall(r"PushedFilters: (.*)", text),
    }
