"""Enumerations: named values, usable in the driver and as expressions."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


class Enum:
    """Names to distinct values: ``e["name"]``, ``e.name``, and ``e(value)`` for the way back."""

    def __init__(self, spec: Any):
        if isinstance(spec, Enum):
            pairs = list(spec)
        elif isinstance(spec, Mapping):
            pairs = list(spec.items())
        elif isinstance(spec, str):
            raise TypeError("an enumeration is a list of names or a mapping")
        else:
            pairs = [(n, k) for k, n in enumerate(spec)]
        if not pairs:
            raise ValueError("an enumeration has at least one name")
        self._values: dict[str, Any] = {}
        for name, value in pairs:
            if not isinstance(name, str) or not name or name.startswith("_"):
                raise ValueError(f"{name!r} is not a name for a value")
            if name in self._values:
                raise ValueError(f"name {name!r} appears twice")
            if value in self._values.values():
                raise ValueError(f"value {value!r} appears twice")
            self._values[name] = value

    def __getitem__(self, name: str) -> Any:
        if not isinstance(name, str):
            raise TypeError("names are strings")
        return self._values[name]

    def __getattr__(self, name: str) -> Any:
        try:
            return self.__dict__["_values"][name]
        except KeyError:
            raise AttributeError(name) from None

    def __call__(self, value: Any, *default: Any) -> str:
        for n, v in self._values.items():
            if v == value:
                return n
        if default:
            return default[0]
        raise ValueError(f"no name has the value {value!r}")

    def __contains__(self, name: str) -> bool:
        return name in self._values

    def __iter__(self) -> Iterator[tuple[str, Any]]:
        return iter(self._values.items())

    def __len__(self) -> int:
        return len(self._values)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Enum) and self._values == other._values

    def __hash__(self) -> int:
        return hash(tuple(sorted(self._values.items())))

    def __repr__(self) -> str:
        return f"Enum({self._values!r})"

    def _map(self, back: bool) -> Column:
        return F.create_map(*[F.lit(x) for n, v in self for x in ((v, n) if back else (n, v))])

    def to_value(self, name: Column) -> Column:
        return F.element_at(self._map(False), name)

    def to_name(self, value: Column) -> Column:
        return F.element_at(self._map(True), value)
