"""The operator catalogue: name, parameters, arity, missing-value policy and how each operator is lowered.

Lowering classes: `expr` (column expression), `window` (window aggregates over a frame), `kernel` (a keyed sequential
state machine), `macro` (an expression over further operators)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Spec:
    """One operator of the catalogue."""

    name: str
    kind: str
    n_in: int
    outputs: tuple[str, ...]
    params: dict[str, Any]
    policy: str
    build: Callable = field(repr=False)

    def bind(self, args: tuple, kwargs: dict) -> dict[str, Any]:
        """The full parameters of a call; raises TypeError for unknown or surplus ones."""
        names = list(self.params)
        if len(args) > len(names):
            raise TypeError(f"{self.name} takes at most {len(names)} parameters")
        got = dict(zip(names, args, strict=False))
        for k, v in kwargs.items():
            if k not in self.params:
                raise TypeError(f"{self.name} has no parameter {k!r}")
            if k in got:
                raise TypeError(f"{self.name}: {k!r} given twice")
            got[k] = v
        return {**self.params, **got}


OPERATORS: dict[str, Spec] = {}
REQUIRED = object()


def operator(name: str, kind: str, n_in: int = 1, outputs: str | tuple[str, ...] = ("",), policy: str = "ignore", **params: Any) -> Callable:
    """Registers the decorated builder as an operator."""

    def add(build: Callable) -> Callable:
        outs = tuple(outputs.split()) if isinstance(outputs, str) else outputs
        OPERATORS[name] = Spec(name, kind, n_in, outs, params, policy, build)
        return build

    return add


START_POLICIES = ("strict", "expanding", "zero")


def check_params(spec: Spec, params: dict[str, Any]) -> None:
    """The checks that all operators share."""
    for k, v in params.items():
        if v is REQUIRED:
            raise TypeError(f"{spec.name} needs {k}")
    if "start_policy" in params and params["start_policy"] not in START_POLICIES:
        raise ValueError(f"start_policy must be one of {', '.join(START_POLICIES)}")
    if "window_size" in params and (not isinstance(params["window_size"], int) or params["window_size"] < 1):
        raise ValueError("window_size must be a positive integer")
    if {"com", "span", "halflife", "alpha"} <= set(params):
        decay(params)


def decay(params: dict[str, Any]) -> float:
    """The smoothing factor alpha from exactly one of com, span, halflife and alpha."""
    given = {k: params[k] for k in ("com", "span", "halflife", "alpha") if params.get(k) is not None}
    if len(given) != 1:
        raise ValueError("give exactly one of com, span, halflife, alpha")
    (k, v), = given.items()
    if k == "com":
        if v < 0:
            raise ValueError("com must not be negative")
        return 1 / (1 + v)
    if k == "span":
        if v < 1:
            raise ValueError("span must be at least 1")
        return 2 / (v + 1)
    if k == "halflife":
        if v <= 0:
            raise ValueError("halflife must be positive")
        return 1 - 0.5 ** (1 / v)
    if not 0 < v <= 1:
        raise ValueError("alpha must be in (0, 1]")
    return float(v)
