"""Tools for multi-turn trajectories: a registry, schema checks and the loop over open trajectories."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.text import calculate, tool_call
from quillgraph.session import materialise


@dataclass
class Tool:
    name: str
    run: Callable[..., str]
    required: list[str] = field(default_factory=list)

    def call(self, args: dict) -> str:
        missing = [k for k in self.required if k not in args]
        if missing:
            return json.dumps({"error": f"missing {', '.join(missing)}"})
        return self.run(**{k: args[k] for k in self.required})


class ToolBox:
    """Named tools; a call names its tool, or the default one gets it."""

    def __init__(self, default: str = "search"):
        self.tools: dict[str, Tool] = {"calculator": Tool("calculator", lambda expression: calculate(expression), ["expression"])}
        self.default = default

    def add(self, name: str, required: list[str]):
        def keep(f):
            self.tools[name] = Tool(name, f, required)
            return f

        return keep

    def answer(self, call: str | None) -> str:
        try:
            args = json.loads(call or "")
        except ValueError:
            return json.dumps({"error": "invalid call"})
        tool = self.tools.get(args.get("tool", self.default))
        return tool.call(args) if tool else json.dumps({"error": "unknown tool"})


def tool_loop(trajectories: DataFrame, respond: Callable[[pd.Series], pd.Series], box: ToolBox, most: int = 5) -> DataFrame:
    """(id, text, turns): trajectories(id, text) continued until a response has no call, or after ``most`` turns."""
    model = F.pandas_udf(respond, "string")
    tool = F.udf(box.answer, "string", useArrow=True)
    now = trajectories.select("id", "text", F.lit(0).alias("turns"), F.lit(True).alias("open"))
    for _ in range(most):
        said = materialise(now.filter("open").withColumn("_r", model("text")), "turn")
        call = tool_call(F.col("_r"))
        reply = F.when(call.isNotNull(), F.concat("text", F.lit("\n"), "_r", F.lit("\n<result>"), tool(call), F.lit("</result>"))).otherwise(F.concat("text", F.lit("\n"), "_r"))
        step = said.select("id", reply.alias("text"), (F.col("turns") + 1).alias("turns"), call.isNotNull().alias("open"))
        now = materialise(now.filter("NOT open").unionByName(step), "turns")
        if now.filter("open").isEmpty():
            break
    return now.select("id", "text", "turns")
