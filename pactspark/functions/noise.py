"""Laplace noise and the privacy budget."""

from __future__ import annotations

import secrets
import threading

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import BudgetExhausted, NoiseTypeUnsupported
from ..policy import DpParam

_EPS = 2.0**-52


def laplace(scale: float, seeds: tuple[int, int] | None = None) -> Column:
    """A sample of the Laplace distribution in each row: the difference of two exponentials."""
    a, b = seeds or (secrets.randbits(62), secrets.randbits(62))
    return F.lit(float(scale)) * (F.log(1 - F.rand(b)) - F.log(1 - F.rand(a)))


def noised(col: Column, kind: T.DataType, param: DpParam, name: str) -> Column:
    """The column plus noise of scale sensitivity / epsilon; integers are rounded half away from zero."""
    param.checked(name)
    sample = laplace(param.sensitivity / param.epsilon)
    if isinstance(kind, T.DoubleType):
        return col + sample
    if isinstance(kind, T.LongType):
        return F.round(col.cast("double") + sample).cast("long")
    raise NoiseTypeUnsupported(name, kind.simpleString())


class PrivacyBudget:
    """Epsilon left for each tenant and column. Without ``initial`` nothing is ever refused."""

    def __init__(self, initial: dict[tuple[str, str], float] | None = None):
        self._lock = threading.Lock()
        self._left = dict(initial) if initial is not None else None
        self._spent: dict[tuple[str, str], float] = {}

    @property
    def enforced(self) -> bool:
        return self._left is not None

    def remaining(self, tenant: str, column: str) -> float:
        """Infinite where budgets are not enforced, zero for a column without one."""
        with self._lock:
            return float("inf") if self._left is None else self._left.get((tenant, column), 0.0)

    def spent(self, tenant: str, column: str) -> float:
        with self._lock:
            return self._spent.get((tenant, column), 0.0)

    def consume(self, tenant: str, costs: dict[str, float]) -> float:
        """Take the costs of all columns or, if one can't be met, of none. Returns their sum."""
        with self._lock:
            if self._left is not None:
                for column, cost in costs.items():
                    left = self._left.get((tenant, column), 0.0)
                    if left < cost - _EPS:
                        raise BudgetExhausted(tenant, column, cost, left)
            for column, cost in costs.items():
                key = (tenant, column)
                self._spent[key] = self._spent.get(key, 0.0) + cost
                if self._left is not None:
                    self._left[key] = max(self._left[key] - cost, 0.0)
        return sum(costs.values())
