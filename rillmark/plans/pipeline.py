"""A pipeline of named transformations, declared before it runs: stages with the columns they need, checked against a schema."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

_REGISTRY: dict[str, Callable[..., DataFrame]] = {}


def operator(name: str):
    """Registers a transformation DataFrame -> DataFrame under a name."""

    def keep(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        _REGISTRY[name] = f
        return f

    return keep


def registered() -> list[str]:
    return sorted(_REGISTRY)


@dataclass
class Stage:
    name: str
    options: dict = field(default_factory=dict)
    needs: tuple[str, ...] = ()


@dataclass
class Pipeline:
    stages: list[Stage]

    def check(self, columns: list[str]) -> list[str]:
        """What keeps the pipeline from starting on these columns."""
        errors = [f"unknown operator {s.name}" for s in self.stages if s.name not in _REGISTRY]
        return errors + [f"{s.name} needs {c}" for s in self.stages[:1] for c in s.needs if c not in columns]

    def apply(self, df: DataFrame) -> DataFrame:
        errors = self.check(df.columns)
        if errors:
            raise ValueError("; ".join(errors))
        for s in self.stages:
            missing = [c for c in s.needs if c not in df.columns]
            if missing:
                raise ValueError(f"{s.name} needs {', '.join(missing)}")
            df = _REGISTRY[s.name](df, **s.options)
        return df


def _register() -> None:
    from rillmark.operators import routing, scheduling, timestamps

    for module in (routing, scheduling, timestamps):
        for name, f in vars(module).items():
            if callable(f) and not name.startswith("_") and getattr(f, "__module__", "") == module.__name__:
                _REGISTRY.setdefault(name, f)


_register()
