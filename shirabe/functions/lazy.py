"""Spark's functions, recorded where no session is active yet and run when their Column is asked for."""

from __future__ import annotations

import operator

from pyspark import SparkContext
from pyspark.sql import functions


class Later:
    def __init__(self, run, args, named=None) -> None:  # noqa: ANN001
        self._run, self._args, self._named = run, args, named or {}

    def __getattr__(self, name: str):  # noqa: ANN204
        if name.startswith("__"):
            raise AttributeError(name)
        return lambda *a, **k: Later(lambda o, *b, **n: getattr(o, name)(*b, **n), (self, *a), k)


def _record(name: str):  # noqa: ANN202
    return lambda self, *a: Later(getattr(operator, name), (self, *a))


for _name in ("add", "sub", "mul", "truediv", "mod", "eq", "ne", "lt", "le", "gt", "ge", "and_", "or_", "invert", "neg"):
    setattr(Later, f"__{_name.rstrip('_')}__", _record(_name))


def resolve(x):  # noqa: ANN001, ANN201
    if isinstance(x, Later):
        return x._run(*map(resolve, x._args), **{k: resolve(v) for k, v in x._named.items()})
    return x


def ready(x):  # noqa: ANN001, ANN201
    return resolve(x) if SparkContext._active_spark_context is not None else x


class _Functions:
    def __getattr__(self, name: str):  # noqa: ANN204
        return lambda *a, **k: ready(Later(getattr(functions, name), a, k))


F = _Functions()
