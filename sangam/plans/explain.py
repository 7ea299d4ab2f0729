"""EXPLAIN [ANALYZE] in TEXT, JSON or XML."""

from __future__ import annotations

import json
import re
import time
from xml.sax.saxutils import quoteattr

from pyspark.sql import DataFrame

LINE = re.compile(r"^([\s:|]*)(?:[+*]?-? ?)?(?:\+- |:- )?(.*)$")


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


def plan_tree(df: DataFrame) -> dict:
    """The physical plan as nested nodes: name, detail, children."""

    def walk(node) -> dict:
        text = node.simpleString(200)
        return {"node": node.nodeName(), "detail": text, "children": [walk(node.children().apply(i)) for i in range(node.children().size())]}

    plan = df._jdf.queryExecution().executedPlan()
    if plan.nodeName() == "AdaptiveSparkPlan":
        plan = plan.executedPlan()
    return walk(plan)


def _xml(node: dict, depth: int = 0) -> str:
    head = f"{'  ' * depth}<node name={quoteattr(node['node'])} detail={quoteattr(node['detail'])}"
    if not node["children"]:
        return head + "/>"
    return head + ">\n" + "\n".join(_xml(x, depth + 1) for x in node["children"]) + f"\n{'  ' * depth}</node>"


def explain(df: DataFrame, form: str = "TEXT", analyze: bool = False) -> str:
    extra = {}
    if analyze:
        began = time.time()
        extra = {"rows": df.count(), "seconds": round(time.time() - began, 3)}
    if form.upper() == "JSON":
        return json.dumps(extra | {"plan": plan_tree(df)})
    if form.upper() == "XML":
        attributes = "".join(f" {k}={quoteattr(str(v))}" for k, v in extra.items())
        return f"<plan{attributes}>\n{_xml(plan_tree(df), 1)}\n</plan>"
    return plan_text(df) + "".join(f"\n{k}: {v}" for k, v in extra.items())
