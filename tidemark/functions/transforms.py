"""Output transforms of features."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The least positive normal double, the floor under ``clipped_lg``.
LEAST = 2.2250738585072014e-308

TRANSFORMS: dict[str, Callable[[Column], Column]] = {
    "arcsinh": F.asinh,
    "clipped_lg": lambda x: F.log10(F.greatest(x, F.lit(LEAST))),
    "identity": lambda x: x,
    "lg": lambda x: F.when(x > 0, F.log10(x)),
    "ln1p": lambda x: F.when(x > -1, F.log1p(x)),
    "sqrt": lambda x: F.when(x >= 0, F.sqrt(x)),
}


def resolve(transform: str | bool | None, default: str) -> str | None:
    """The name of a transform: None and False mean none, True and ``default`` the feature's own."""
    if transform is None or transform is False:
        return None
    if transform is True or transform == "default":
        return default
    if transform not in TRANSFORMS:
        raise ValueError(f"unknown transform {transform!r}; there are {', '.join(sorted(TRANSFORMS))}, default")
    return transform
