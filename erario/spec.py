"""Shapes of the star and of a training run, narrowed to the columns at hand."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Iterable

from erario import fixed


@dataclass(frozen=True)
class DimSpec:
    name: str
    sk: str
    keys: tuple[str, ...]
    sort: tuple[str, ...]

    @property
    def order(self) -> tuple[str, ...]:
        """Listed sort columns, then the other keys: a total order over members."""
        return self.sort + tuple(k for k in self.keys if k not in self.sort)


@dataclass(frozen=True)
class StarSpec:
    dims: tuple[DimSpec, ...]
    amounts: tuple[str, ...]
    attributes: tuple[str, ...]
    line_key: str = fixed.LINE_KEY

    @classmethod
    def full(cls) -> StarSpec:
        dims = tuple(DimSpec(n, sk, keys, sort) for n, (sk, keys, sort) in fixed.DIMENSIONS.items())
        return cls(dims, fixed.AMOUNTS, fixed.FACT_ATTRIBUTES)

    @classmethod
    def of(cls, columns: Iterable[str]) -> StarSpec:
        """The full star without the columns a source does not carry."""
        have = set(columns)

        def keep(names):
            return tuple(n for n in names if n in have)

        whole = cls.full()
        dims = tuple(
            DimSpec(d.name, d.sk, keep(d.keys), keep(d.sort))
            for d in whole.dims
            if keep(d.keys)
        )
        return cls(dims, keep(whole.amounts), keep(whole.attributes))

    def dim(self, name: str) -> DimSpec:
        return next(d for d in self.dims if d.name == name)

    def owner(self, column: str) -> DimSpec | None:
        """The first dimension that carries a label column."""
        return next((d for d in self.dims if column in d.keys), None)

    @property
    def sks(self) -> tuple[str, ...]:
        return tuple(d.sk for d in self.dims)

    @property
    def fact_order(self) -> tuple[str, ...]:
        """Total order of fact rows.  Keys are numbered in sort order, so ordering by
        them equals ordering by the natural keys, on seven longs instead of texts."""
        own = tuple(a for a in self.attributes if a not in fixed.DERIVED)
        return self.sks + (self.line_key,) + self.amounts + own


@dataclass(frozen=True)
class TrainConfig:
    """``fast`` is the short profile: 3 folds, 120 boosting rounds, no forest."""

    fast: bool = False
    folds: int | None = None
    boosting_rounds: int | None = None
    candidates: tuple[str, ...] | None = None
    sample_size: int = 0
    test_share: float = fixed.TEST_SHARE
    seed: int = fixed.SEED
    parallel_fits: int = 2
    parallel_folds: int = 6

    @property
    def n_folds(self) -> int:
        return self.folds or (3 if self.fast else 5)

    @property
    def rounds(self) -> int:
        return self.boosting_rounds or (120 if self.fast else 200)
