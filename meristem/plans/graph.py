"""Node graphs as lazy plans.

A graph is a dictionary of nodes (id, type, data.params) and edges (source, sourceHandle, target,
targetHandle; handles are `colour__port`). Building it calls each registered operator once, in
topological order, and gives DataFrames; nothing runs before an action, so Catalyst sees the whole
plan, and nodes that no output needs cost nothing.
"""

from __future__ import annotations

import inspect
from collections import defaultdict, deque
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import get

PASS_THROUGH = {"reroute", "canvas_reroute"}
NO_CONTENT = {"note", "canvas_note", "canvas_frame"}
GROUPS = {"group_node", "group_input", "group_output"}


def _port(handle: str | None) -> str:
    return (handle or "main").split("__", 1)[-1]


def flatten(graph: dict) -> dict:
    """Sub-graphs in data.subGraph replaced by their nodes, named group::inner, with their edges reconnected."""
    nodes, edges = [], list(graph["edges"])
    for n in graph["nodes"]:
        inner = n.get("data", {}).get("subGraph")
        if n["type"] != "group_node" or not inner:
            nodes.append(n)
            continue
        inner = flatten(inner)
        name = lambda i, g=n["id"]: f"{g}::{i}"
        kinds = {m["id"]: m["type"] for m in inner["nodes"]}
        nodes += [m | {"id": name(m["id"])} for m in inner["nodes"] if m["type"] not in ("group_input", "group_output")]
        into = {_port(e.get("sourceHandle")): [] for e in inner["edges"] if kinds.get(e["source"]) == "group_input"}
        out = {}
        for e in inner["edges"]:
            if kinds.get(e["source"]) == "group_input":
                into[_port(e.get("sourceHandle"))].append((name(e["target"]), e.get("targetHandle")))
            elif kinds.get(e["target"]) == "group_output":
                out[_port(e.get("targetHandle"))] = (name(e["source"]), e.get("sourceHandle"))
            else:
                edges.append(e | {"source": name(e["source"]), "target": name(e["target"])})
        rest = []
        for e in edges:
            if e["target"] == n["id"]:
                rest += [e | {"target": t, "targetHandle": h} for t, h in into.get(_port(e.get("targetHandle")), ())]
            elif e["source"] == n["id"] and _port(e.get("sourceHandle")) in out:
                s, h = out[_port(e.get("sourceHandle"))]
                rest.append(e | {"source": s, "sourceHandle": h})
            elif e["source"] != n["id"]:
                rest.append(e)
        edges = rest
    return {"nodes": nodes, "edges": edges}


def contract(graph: dict) -> dict:
    """Pass-through nodes taken out, their edges joined; nodes without content dropped."""
    kinds = {n["id"]: n["type"] for n in graph["nodes"]}
    before = {e["target"]: (e["source"], e.get("sourceHandle")) for e in graph["edges"] if kinds.get(e["target"]) in PASS_THROUGH}

    def origin(node: str, handle: str | None) -> tuple[str, str | None]:
        seen = set()
        while node in before and node not in seen:
            seen.add(node)
            node, handle = before[node]
        return node, handle

    edges = []
    for e in graph["edges"]:
        if kinds.get(e["target"]) not in PASS_THROUGH:
            s, h = origin(e["source"], e.get("sourceHandle"))
            edges.append(e | {"source": s, "sourceHandle": h})
    gone = PASS_THROUGH | NO_CONTENT
    nodes = [n for n in graph["nodes"] if n["type"] not in gone]
    known = {n["id"] for n in nodes}
    return {"nodes": nodes, "edges": [e for e in edges if e["source"] in known and e["target"] in known]}


def topological(graph: dict) -> list[dict]:
    """Nodes in an order that edges allow; a cycle is an error (feedback is an operator of its own)."""
    by_id = {n["id"]: n for n in graph["nodes"]}
    waits, after = {n: 0 for n in by_id}, defaultdict(list)
    for e in graph["edges"]:
        waits[e["target"]] += 1
        after[e["source"]].append(e["target"])
    ready, out = deque(n for n, k in waits.items() if k == 0), []
    while ready:
        n = ready.popleft()
        out.append(by_id[n])
        for t in after[n]:
            waits[t] -= 1
            if not waits[t]:
                ready.append(t)
    if len(out) < len(by_id):
        raise ValueError(f"the graph has a cycle through {sorted(set(by_id) - {n['id'] for n in out})}")
    return out


def _outputs(result: Any) -> dict[str, Any]:
    if isinstance(result, dict) and all(isinstance(v, DataFrame) for v in result.values()):
        return result
    if isinstance(result, tuple):
        return {"main": result[0], "out_a": result[0], "out_b": result[1], "train": result[0], "test": result[1]}
    return {"main": result}


def build(spark: SparkSession, graph: dict, tables: dict[str, DataFrame] | None = None) -> dict[str, dict[str, Any]]:
    """Outputs by node id and port. A node of type `table` gives tables[params.name].

    An input goes to the parameter of its port's name, else to the operator's next free one. Column
    operators take the table at their first input and add the column params.out, computed from the
    columns that params.columns names by parameter.
    """
    graph = contract(flatten(graph))
    into = defaultdict(list)
    for e in graph["edges"]:
        into[e["target"]].append(e)
    done: dict[str, dict[str, Any]] = {}
    for node in topological(graph):
        params = dict(node.get("data", {}).get("params", {}))
        inputs = []
        for e in into[node["id"]]:
            ports = done[e["source"]]
            inputs.append((_port(e.get("targetHandle")), ports.get(_port(e.get("sourceHandle")), ports.get("main"))))
        if node["type"] == "table":
            done[node["id"]] = {"main": (tables or {})[params["name"]]}
            continue
        op = get(node["type"])
        if op.kind == "column":
            df = inputs[0][1]
            columns = {k: F.col(f"`{v}`") for k, v in params.pop("columns", {}).items()}
            done[node["id"]] = {"main": df.withColumn(params.pop("out", "result"), op.build(**columns, **params))}
            continue
        signature = list(inspect.signature(op.build).parameters)
        args = {p: v for p, v in inputs if p in signature}
        free = [p for p in signature if p not in args and p not in params and p != "spark"]
        for p, v in inputs:
            if p not in signature:
                args[free.pop(0)] = v
        if op.kind == "source":
            args["spark"] = spark
        done[node["id"]] = _outputs(op.build(**args, **params))
    return done


def run(spark: SparkSession, graph: dict, node: str, tables: dict[str, DataFrame] | None = None, port: str = "main") -> DataFrame:
    return build(spark, graph, tables)[node][port]
