"""Pipelines: graphs of stream operators and operators, built once and run on frames; with a JSON form and text and
dot renderings. A pipeline holds no data. Running it composes DataFrames, so Catalyst sees the whole graph; a node that is
used twice is built once."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame

from ..operators import streams as st
from ..operators.streams import Stream
from .node import Operator, make

#: Stream operators that a graph may hold, with the names of their parameters.
STREAM_OPS = {
    "select": ("columns",), "dropna": ("how",), "filter_by": (), "combine_latest": ("emit",), "delay": ("duration",),
    "resample": ("agg", "freq", "every", "count", "threshold", "driver", "origin", "label", "fill", "max_age"),
}
VERSION = 1


class Flow:
    """A node of a pipeline's graph."""

    def __init__(self, kind: str, params: dict[str, Any], inputs: tuple[Flow, ...] = (), operator: Operator | None = None) -> None:
        self.kind, self.params, self.inputs, self.operator = kind, params, inputs, operator

    @property
    def label(self) -> str:
        if self.kind == "input":
            return self.params["name"]
        if self.operator is not None:
            own = ", ".join(f"{k}={v!r}" for k, v in self.operator.params.items() if self.operator.spec.params[k] != v)
            return f"{self.operator.spec.name}({own})"
        return f"{self.kind}({', '.join(f'{k}={_plain(v)!r}' for k, v in self.params.items() if v is not None)})"


def _plain(v: Any) -> Any:
    return {"operator": v.spec.name, "params": v.params} if isinstance(v, Operator) else v


def source(name: str) -> Flow:
    """A named input."""
    return Flow("input", {"name": name})


def apply(operator: Operator, *inputs: Flow) -> Flow:
    """An operator over the columns of its inputs, which are aligned first where there are several."""
    return Flow("apply", {}, inputs, operator)


def flow(kind: str, *inputs: Flow, **params: Any) -> Flow:
    """A stream operator; resample takes a clock as its second input."""
    if kind not in STREAM_OPS:
        raise ValueError(f"no stream operator {kind}; merge is for frames only")
    unknown = set(params) - set(STREAM_OPS[kind])
    if unknown:
        raise TypeError(f"{kind} has no parameter {', '.join(sorted(unknown))}")
    return Flow(kind, params, inputs)


class Pipeline:
    """A graph from named inputs to named outputs."""

    def __init__(self, inputs: list[Flow], outputs: dict[str, Flow]) -> None:
        self.inputs, self.outputs = inputs, outputs
        self.nodes: list[Flow] = []
        for o in outputs.values():
            self._visit(o, ())
        used = {id(n) for n in self.nodes if n.kind == "input"}
        unused = [i.params["name"] for i in inputs if id(i) not in used]
        if unused:
            raise ValueError(f"inputs that nothing uses: {', '.join(unused)}")
        undeclared = [n.params["name"] for n in self.nodes if n.kind == "input" and n not in inputs]
        if undeclared:
            raise ValueError(f"inputs that aren't declared: {', '.join(undeclared)}")

    def _visit(self, n: Flow, above: tuple) -> None:
        if id(n) in above:
            raise ValueError("a pipeline has no cycles")
        for i in n.inputs:
            self._visit(i, (*above, id(n)))
        if all(n is not m for m in self.nodes):
            self.nodes.append(n)

    def __call__(self, **feeds: Stream) -> dict[str, Stream]:
        """The outputs for the given streams."""
        names = {i.params["name"] for i in self.inputs}
        if set(feeds) != names:
            raise ValueError(f"the pipeline needs {', '.join(sorted(names))}")
        made: dict[int, Stream] = {}
        for n in self.nodes:
            made[id(n)] = self._build(n, [made[id(i)] for i in n.inputs], feeds)
        return {k: made[id(o)] for k, o in self.outputs.items()}

    @staticmethod
    def _build(n: Flow, ins: list[Stream], feeds: dict[str, Stream]) -> Stream:
        if n.kind == "input":
            return feeds[n.params["name"]]
        if n.kind == "apply":
            return (ins[0] if len(ins) == 1 else st.combine_latest(*ins)).apply(n.operator)
        if n.kind == "resample":
            p = dict(n.params)
            return st.resample(ins[0], p.pop("agg", "last"), clock=ins[1] if len(ins) > 1 else None, **p)
        return getattr(st, n.kind)(*ins, **n.params)

    def aligned(self, **feeds: Stream) -> DataFrame:
        """All outputs in one frame, each one's latest values at every index."""
        outs = self(**feeds)
        named = [s.like(s.df.withColumnsRenamed({v: f"{k}_{v}" for v in s.values}), [f"{k}_{v}" for v in s.values]) for k, s in outs.items()]
        return st.combine_latest(*named).df if len(named) > 1 else named[0].df

    # -- forms ----------------------------------------------------------------------------------------------------

    def to_dict(self) -> dict[str, Any]:
        number = {id(n): i for i, n in enumerate(self.nodes)}
        nodes = []
        for n in self.nodes:
            params = {k: _plain(v) for k, v in n.params.items()}
            if n.operator is not None:
                params = {"operator": n.operator.spec.name, "params": n.operator.params}
            nodes.append({"kind": n.kind, "params": params, "inputs": [number[id(i)] for i in n.inputs]})
        return {"version": VERSION, "nodes": nodes, "outputs": {k: number[id(o)] for k, o in self.outputs.items()}}

    def to_json(self) -> str:
        return json.dumps(self.to_dict())

    @classmethod
    def from_dict(cls, d: dict[str, Any]) -> Pipeline:
        if d.get("version") != VERSION:
            raise ValueError(f"version {d.get('version')} isn't {VERSION}")
        nodes: list[Flow] = []
        for n in d["nodes"]:
            ins, p = tuple(nodes[i] for i in n["inputs"]), dict(n["params"])
            if n["kind"] == "apply":
                nodes.append(apply(make(p["operator"], **p["params"]), *ins))
            elif n["kind"] == "input":
                nodes.append(source(p["name"]))
            else:
                if isinstance(p.get("agg"), dict):
                    p["agg"] = make(p["agg"]["operator"], **p["agg"]["params"])
                nodes.append(flow(n["kind"], *ins, **p))
        return cls([n for n in nodes if n.kind == "input"], {k: nodes[i] for k, i in d["outputs"].items()})

    @classmethod
    def from_json(cls, text: str) -> Pipeline:
        return cls.from_dict(json.loads(text))

    def to_text(self) -> str:
        number = {id(n): i for i, n in enumerate(self.nodes)}
        lines = [f"{i}: {n.label}" + (f" <- {', '.join(str(number[id(x)]) for x in n.inputs)}" if n.inputs else "") for i, n in enumerate(self.nodes)]
        return "\n".join([*lines, *(f"{k} = {number[id(o)]}" for k, o in self.outputs.items())])

    def to_dot(self) -> str:
        number = {id(n): i for i, n in enumerate(self.nodes)}
        quoted = lambda s: json.dumps(s)
        out = ["digraph pipeline {"]
        for i, n in enumerate(self.nodes):
            out.append(f"  n{i} [label={quoted(n.label)}];")
            out += [f"  n{number[id(x)]} -> n{i};" for x in n.inputs]
        for k, o in self.outputs.items():
            out += [f"  {quoted(k)} [shape=box];", f"  n{number[id(o)]} -> {quoted(k)};"]
        return "\n".join([*out, "}"])
