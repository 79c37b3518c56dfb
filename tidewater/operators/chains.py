"""Chains: graphs of kernels that run in one Arrow pass.

A kernel's output loses the frame's partitioning, so whatever follows it by key would shuffle again. Therefore what lies
between and behind kernels is ported into their pass: rolling operators in their block forms, and the short expressions
and lags below, written over arrays. `ported` rewrites a graph so; `Chain` holds the state of one key's jobs, in the order
of their inputs, for a batch pass or a stream alike."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from ..plans.registry import OPERATORS, operator
from .fast import FAST
from .kernels import NAN, Kernel

PORTABLE: dict[str, str] = {}


def _port(name: str, cls: type[Kernel]) -> None:
    spec = OPERATORS[name]
    cls.n_out, cls.__name__, cls.__qualname__, cls.__module__ = len(spec.outputs), f"_Ported{name}", f"_Ported{name}", __name__
    globals()[cls.__name__] = cls
    operator(cls.__name__, "kernel", spec.n_in, spec.outputs, spec.policy, **spec.params)(cls)
    PORTABLE[name] = cls.__name__


class _Rule(Kernel):
    """A rule over whole arrays, without state."""

    finite = True
    rule: Callable

    def __init__(self, **p) -> None:
        self.p = p

    def block(self, *x: np.ndarray) -> list[np.ndarray]:
        with np.errstate(all="ignore"):
            out = type(self).rule(self.p, *x)
        return [np.asarray(o, float) for o in (out if isinstance(out, tuple) else (out,))]

    def step(self, *x: float):
        out = [float(o[0]) for o in self.block(*(np.array([v], float) for v in x))]
        return out[0] if self.n_out == 1 else tuple(out)


def _rule(name: str, rule: Callable) -> None:
    _port(name, type("rule", (_Rule,), {"rule": staticmethod(rule)}))


def _divided(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """IEEE division by zero of either sign as by a positive one; 0/0 is missing."""
    return np.where(b != 0, a / np.where(b != 0, b, 1), np.where(a > 0, np.inf, np.where(a < 0, -np.inf, NAN)))


for _name, _of in {
    "Add": lambda p, x, y: x + y, "Sub": lambda p, x, y: x - y, "Mul": lambda p, x, y: x * y, "Div": lambda p, x, y: _divided(x, y),
    "Linear": lambda p, x: p["scale"] * x + p["shift"], "Linear2": lambda p, x, y: p["a"] * x + p["b"] * y + p["c"],
    "Abs": lambda p, x: np.abs(x), "Sqrt": lambda p, x: np.where(x >= 0, np.sqrt(np.maximum(x, 0)), NAN), "Square": lambda p, x: x * x, "Identity": lambda p, x: x,
    "_Half": lambda p, a, b: (a + b) / 2, "_Together": lambda p, k, d: (k, d), "_PercentOf": lambda p, a, b: _divided(100 * a, b), "_ThirdOfThree": lambda p, a, b, c: c,
    "_Band": lambda p, mid, half: (mid - p["width"] * half, mid, mid + p["width"] * half),
}.items():
    _rule(_name, _of)


class _Lagged(Kernel):
    """Carries the last n values."""

    finite = True

    def __init__(self, **p) -> None:
        self.p = p
        self.held = np.full(self.reach(p), NAN)

    @staticmethod
    def reach(p) -> int:
        return 1

    def moved(self, x: np.ndarray) -> np.ndarray:
        """The values so many rows back; missing before the first."""
        both = np.concatenate([self.held, x])
        self.held = both[len(both) - len(self.held) :]
        return both[: len(x)]

    def step(self, *x: float):
        return float(self.block(*(np.array([v], float) for v in x))[0][0])


class _BeforeRows(_Lagged):
    def block(self, x: np.ndarray) -> list[np.ndarray]:
        return [self.moved(x)]


class _BackRows(_BeforeRows):
    @staticmethod
    def reach(p) -> int:
        return p["n"]


class _StepRows(_Lagged):
    def block(self, x: np.ndarray) -> list[np.ndarray]:
        return [x - self.moved(x)]


class _TrueRangeRows(_Lagged):
    def block(self, h: np.ndarray, low: np.ndarray, c: np.ndarray) -> list[np.ndarray]:
        old = self.moved(c)
        return [np.maximum(h - low, np.maximum(np.abs(h - old), np.abs(low - old)))]


class _AfterRows(Kernel):
    finite = False

    def __init__(self, n: int = 1) -> None:
        self.left = n - 1

    def block(self, x: np.ndarray) -> list[np.ndarray]:
        out = x.astype(float)
        out[: self.left] = NAN
        self.left = max(self.left - len(x), 0)
        return [out]

    def step(self, x: float) -> float:
        return float(self.block(np.array([x], float))[0][0])


for _name, _cls in {"_Before": _BeforeRows, "_Back": _BackRows, "_Step": _StepRows, "TrueRange": _TrueRangeRows, "_After": _AfterRows}.items():
    _port(_name, _cls)
PORTABLE.update(FAST)


def ported(node, everything: bool = False):
    """The graph with what can run in a kernel pass written so: what lies behind a kernel and has something by key behind
    it, or everything, for streams. Expressions at a graph's end stay expressions."""
    from ..plans.node import Node

    seen: dict[tuple, tuple] = {}

    def late(n) -> bool:
        return n.spec is not None and (n.spec.kind == "kernel" or any(map(late, n.inputs)))

    def visit(n, inside: bool):
        if n.spec is None:
            return n
        key = (n.key, inside)
        if key not in seen:
            here = everything or (any(map(late, n.inputs)) and (inside or n.spec.kind != "expr"))
            name = PORTABLE.get(n.spec.name, n.spec.name) if here else n.spec.name
            spec = OPERATORS[name]
            seen[key] = (spec, tuple(visit(i, everything or spec.kind == "kernel") for i in n.inputs))
        spec, inputs = seen[key]
        return Node(spec, n.params, inputs, n.output)

    return visit(node, everything)


class Chain:
    """The kernels of one key, each with the names of its inputs and outputs, inputs before their users."""

    def __init__(self, jobs: list) -> None:
        self.jobs = [(cls(**params), ins, outs) for cls, params, ins, outs in jobs]

    def run(self, values: dict[str, np.ndarray], n: int) -> dict[str, np.ndarray]:
        """The values by name of n rows, and those of all outputs; missing is NaN."""
        values = dict(values)
        for k, ins, outs in self.jobs:
            part = [values[i] for i in ins]
            ok = np.ones(n, bool)
            for p in () if k.sparse else part:
                ok &= ~np.isnan(p)
            made = k.block(*([p[ok] for p in part] if not ok.all() else part))
            for o, v in zip(outs, made, strict=True):
                if ok.all():
                    values[o] = np.asarray(v, float)
                else:
                    values[o] = np.full(n, NAN)
                    values[o][ok] = v
        return values
