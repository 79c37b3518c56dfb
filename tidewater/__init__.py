"""tidewater: causal time-series analytics on Spark DataFrames."""

from __future__ import annotations

from .frame import Series, series
from .functions import elementwise as _elementwise
from .operators import backtest as _backtest
from .operators import kernels as _kernels
from .operators import windows as _windows
from .operators import fast as _fast  # noqa: I001  block forms of what the modules above register
from .operators import chains as _chains
from .operators.backtest import MARKET, backtest_report, portfolio_report
from .plans.node import Input, Node, make
from .plans.registry import OPERATORS


class _Catalogue:
    """Operators as attributes: ops.RollingMean(20)("value")."""

    def __getattr__(self, name: str):
        if name.startswith("_") or name not in OPERATORS:
            raise AttributeError(f"no operator {name}")
        return lambda *a, **k: make(name, *a, **k)

    def __dir__(self) -> list[str]:
        return [n for n in OPERATORS if not n.startswith("_")]


ops = _Catalogue()

__all__ = ["MARKET", "OPERATORS", "Input", "Node", "Series", "backtest_report", "make", "ops", "portfolio_report", "series"]
