"""Symbolic nodes and their lowering to a DataFrame.

`Op(params)(inputs)` makes a Node without touching data. `lower` turns nodes into columns of a frame in rounds: all
expressions that are ready go into one projection, all window operators that are ready into one select (Catalyst merges
those with one partition spec into one Window), and all kernels that are ready into one Arrow pass over each key's rows.
Equal nodes (same operator, parameters and inputs) are computed once. The frame is dealt out by its key once; the
windows of every round reuse that partitioning."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .registry import OPERATORS, Spec, check_params

TEMP = "_tw"


class Node:
    """An output of an operator over inputs: other nodes, or columns by name."""

    def __init__(self, spec: Spec | None, params: dict[str, Any], inputs: tuple, output: int = 0, name: str | None = None) -> None:
        self.spec, self.params, self.inputs, self.output, self.name = spec, params, inputs, output, name

    @property
    def key(self) -> tuple:
        """What makes two nodes equal, without the choice of output."""
        if self.spec is None:
            return ("input", self.name)
        frozen = tuple((k, tuple(v) if isinstance(v, list) else v) for k, v in sorted(self.params.items()))
        return (self.spec.name, frozen, tuple((i.key, i.output) for i in self.inputs))

    def __getitem__(self, i: int | str) -> Node:
        """One output of an operator with several."""
        outs = self.spec.outputs
        i = outs.index(i) if isinstance(i, str) else i
        if not 0 <= i < len(outs):
            raise IndexError(f"{self.spec.name} has {len(outs)} outputs")
        return Node(self.spec, self.params, self.inputs, i)

    def __repr__(self) -> str:
        if self.spec is None:
            return self.name
        mine = [f"{k}={v!r}" for k, v in self.params.items() if self.spec.params[k] != v]
        tail = f".{self.spec.outputs[self.output]}" if len(self.spec.outputs) > 1 else ""
        return f"{self.spec.name}({', '.join(mine)})({', '.join(map(repr, self.inputs))}){tail}"


def Input(name: str) -> Node:  # noqa: N802
    """A column of the frame as a node."""
    return Node(None, {}, (), name=name)


def as_node(x: Node | str) -> Node:
    return x if isinstance(x, Node) else Input(x)


class Operator:
    """A configured operator; call it on inputs to get a node."""

    def __init__(self, spec: Spec, args: tuple = (), kwargs: dict | None = None) -> None:
        self.spec, self.params = spec, spec.bind(args, kwargs or {})
        check_params(spec, self.params)

    def __call__(self, *inputs: Node | str) -> Node:
        if len(inputs) != self.spec.n_in:
            raise TypeError(f"{self.spec.name} takes {self.spec.n_in} inputs, got {len(inputs)}")
        return Node(self.spec, self.params, tuple(as_node(i) for i in inputs))


def make(name: str, *args: Any, **kwargs: Any) -> Operator:
    if name not in OPERATORS:
        raise KeyError(f"no operator {name}")
    return Operator(OPERATORS[name], args, kwargs)


class Frames:
    """The windows of one operator: by key and validity of its inputs, in the frame's order."""

    def __init__(self, key: list[str], order: list[str], valid: Column | None, bounded: bool = False) -> None:
        self.bounded = bounded
        self.valid = F.lit(True) if valid is None else valid
        part = [*map(F.col, key), *([] if valid is None else [valid])]
        # without a key the whole frame is one series
        self.spec = Window.partitionBy(*part).orderBy(*order) if part else Window.orderBy(*order)

    def roll(self, k: int):
        return self.spec.rowsBetween(-(int(k) - 1), 0)

    @property
    def past(self):
        if self.bounded:
            raise ValueError("an operator that needs a series' whole past can't run on pieces of it")
        return self.spec.rowsBetween(Window.unboundedPreceding, 0)

    @property
    def pos(self) -> Column:
        """1 for the first valid row of a series."""
        return F.row_number().over(self.spec)


def missing(c: Column) -> Column:
    """The column with NaN as null."""
    return F.nanvl(c, F.lit(None).cast("double"))


def _inputs(node: Node, at: dict) -> list[Column]:
    return [F.col(at[i.key][i.output]) for i in node.inputs]


def _results(node: Node, cols: list[Column], key: list[str], order: list[str], bounded: bool = False) -> list[Column]:
    spec = node.spec
    valid = None
    for c in cols:
        valid = c.isNotNull() if valid is None else valid & c.isNotNull()
    if spec.kind == "expr":
        out = spec.build(*cols, **node.params)
        out = list(out) if isinstance(out, (list, tuple)) else [out]
        return [missing(o if spec.policy == "aware" else F.when(valid, o)) for o in out]
    if bounded and spec.name == "_Pos":
        raise ValueError("row numbers need a series' whole past")
    frames = Frames(key, order, valid if spec.policy == "ignore" else None, bounded)
    out = spec.build(frames, *cols, **node.params)
    out = list(out) if isinstance(out, (list, tuple)) else [out]
    return [missing(F.when(valid, o) if spec.policy == "ignore" else o) for o in out]


def expand(node: Node) -> Node:
    """The node with macros replaced by what they stand for, and long windows by their block forms."""
    if node.spec is None:
        return node
    inputs = tuple(expand(i) for i in node.inputs)
    if node.spec.kind == "macro":
        made = node.spec.build(*inputs, **node.params)
        made = list(made) if isinstance(made, (list, tuple)) else [made]
        return expand(made[node.output])
    from ..operators.fast import choose

    return Node(OPERATORS[choose(node.spec.name, node.params)], node.params, inputs, node.output)


def lower(df: DataFrame, key: list[str], order: list[str], outputs: dict[str, Node | str], bounded: bool = False, columns: list[str] | None = None) -> DataFrame:
    """The frame with the nodes' columns added (an existing column of the same name is replaced). `order` must be a
    total order within a key, or tied rows come in any order. Double columns' NaN count as missing. With `bounded`,
    operators without a finite memory are refused. With `columns`, only those of the frame's columns stay."""
    from ..operators.chains import ported
    from ..operators.kernels import run_kernels

    wanted = {n: ported(expand(as_node(x))) for n, x in outputs.items()}
    at: dict[tuple, list[str]] = {}
    todo: dict[tuple, Node] = {}

    def visit(n: Node) -> None:
        if n.key in todo or n.key in at:
            return
        for i in n.inputs:
            visit(i)
        todo[n.key] = n

    for n in wanted.values():
        visit(n)
    base, temps = list(df.columns), 0
    stay = base if columns is None else columns
    sources = {n.name: n for n in todo.values() if n.spec is None}
    absent = set(sources) - set(base)
    if absent:
        raise ValueError(f"the frame has no column {', '.join(sorted(absent))}")
    types = dict(df.dtypes)
    plain = []
    for name, n in sources.items():
        temp = f"{TEMP}{temps}"
        temps += 1
        c = F.col(name).cast("double")
        plain.append((missing(c) if types[name] in ("double", "float") else c).alias(temp))
        at[n.key] = [temp]
        todo.pop(n.key)
    if any(n.spec.kind in ("window", "kernel") for n in todo.values()) and key:
        df = df.repartition(*key)
    df = df.select("*", *plain)
    def ready(kind: str) -> dict[tuple, Node]:
        return {k: n for k, n in todo.items() if n.spec.kind == kind and all(i.key in at for i in n.inputs)}

    def named(nodes: dict[tuple, Node]) -> None:
        nonlocal temps
        for k, n in nodes.items():
            at[k] = [f"{TEMP}{temps + i}" for i in range(len(n.spec.outputs))]
            temps += len(n.spec.outputs)
            todo.pop(k)

    while todo:
        kind = next((k for k in ("expr", "window", "kernel") if ready(k)), None)
        if kind is None:
            raise AssertionError("nodes without an order")
        if kind == "kernel":
            # with all kernels that follow from these alone
            chain: dict[tuple, Node] = {}
            while more := ready("kernel"):
                named(more)
                chain.update(more)
            endless = [n.spec.name for n in chain.values() if not n.spec.build.finite] if bounded else []
            if endless:
                raise ValueError(f"{', '.join(endless)} need a series' whole past")
            used = {at[i.key][i.output] for n in todo.values() for i in n.inputs if i.key in at} | {at[n.key][n.output] for n in wanted.values() if n.key in at}
            by_key = any(n.spec.kind != "expr" for n in todo.values())
            onward = [c for c in df.columns if c in used or c in stay or (by_key and c in (*key, *order))]
            df = run_kernels(df, key, order, [(n, [at[i.key][i.output] for i in n.inputs], at[k]) for k, n in chain.items()], used, onward)
        else:
            nodes = ready(kind)
            named(nodes)
            df = df.select("*", *[c.alias(a) for k, n in nodes.items() for c, a in zip(_results(n, _inputs(n, at), key, order, bounded), at[k], strict=True)])
    new = [F.col(at[n.key][n.output]).alias(name) for name, n in wanted.items()]
    return df.select(*[c for c in stay if c not in outputs], *new)
