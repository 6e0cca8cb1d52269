"""Column selection by name, pattern and type, and across()."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from .. import dtypes as D
from ..errors import ColumnNotFoundError, ExprTypeError
from ..functions.expr import Expr, column


@dataclass(frozen=True)
class Selector:
    picks: Callable[[str, D.DType], bool]
    negative: bool = False

    def __neg__(self) -> Selector:
        return Selector(self.picks, not self.negative)


def starts_with(prefix: str) -> Selector:
    return Selector(lambda name, t: name.startswith(prefix))


def ends_with(suffix: str) -> Selector:
    return Selector(lambda name, t: name.endswith(suffix))


def contains(part: str) -> Selector:
    return Selector(lambda name, t: part in name)


def matches(pattern: str) -> Selector:
    return Selector(lambda name, t: re.search(pattern, name) is not None)


def where(predicate: Callable[[D.DType], bool]) -> Selector:
    return Selector(lambda name, t: predicate(t))


def everything() -> Selector:
    return Selector(lambda name, t: True)


def is_numeric(t: D.DType) -> bool:
    return t.is_numeric


def is_string(t: D.DType) -> bool:
    return t == D.Str


def is_bool(t: D.DType) -> bool:
    return t == D.Bool


def plain_name(ref, schema: dict[str, D.DType]) -> str:
    """The name that a string or a bare column refers to."""
    name = ref if isinstance(ref, str) else ref._name if isinstance(ref, Expr) and ref._kind == "col" else None
    if name is None:
        raise ExprTypeError(f"a column is needed here, not {ref!r}")
    if name not in schema:
        raise ColumnNotFoundError(name, schema)
    return name


def resolve(refs, schema: dict[str, D.DType]) -> list[str]:
    """Names in the order given, each once; negative ones are taken away last, from all if there are no others."""
    keep, drop, positive = [], set(), False
    for ref in refs:
        if isinstance(ref, (list, tuple)):
            names, negative = resolve(ref, schema), False
        elif isinstance(ref, Selector):
            names, negative = [n for n, t in schema.items() if ref.picks(n, t)], ref.negative
        elif isinstance(ref, Expr) and hasattr(ref, "_negated"):
            names, negative = [plain_name(ref._negated, schema)], True
        elif isinstance(ref, str) and ref.startswith("-") and ref not in schema:
            names, negative = [plain_name(ref[1:], schema)], True
        else:
            names, negative = [plain_name(ref, schema)], False
        positive |= not negative
        (drop.update if negative else keep.extend)(names)
    keep = keep if positive else list(schema)
    return [n for n in dict.fromkeys(keep) if n not in drop]


SHORTCUTS = ("mean", "median", "sum", "min", "max", "std", "var", "n_unique", "first", "last")


@dataclass(frozen=True)
class Across:
    selector: object
    functions: object
    names: str | None

    def expand(self, schema: dict[str, D.DType], groups: tuple[str, ...]) -> dict[str, Expr]:
        fns = self.functions
        several = isinstance(fns, (list, tuple, dict))
        if isinstance(fns, dict):
            named = list(fns.items())
        else:
            named = [(f if isinstance(f, str) else getattr(f, "__name__", f"fn{i}"), f) for i, f in enumerate(fns if several else [fns])]
        form = self.names or ("{col}_{fn}" if several else "{col}")
        chosen = self.selector if isinstance(self.selector, (list, tuple)) else [self.selector]
        out = {}
        for name in resolve(chosen, schema):
            if name in groups:
                continue
            for label, f in named:
                if isinstance(f, str):
                    if f not in SHORTCUTS:
                        raise ExprTypeError(f"across knows {', '.join(SHORTCUTS)}, not {f!r}")
                    made = getattr(column(name), f)()
                else:
                    made = f(column(name))
                out[form.format(col=name, fn=label)] = made
        return out


def across(selector, functions, names: str | None = None) -> Across:
    return Across(selector, functions, names)
