"""Typed settings of plug-ins: defaults, checks, and what is wrong with the values given."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any


@dataclass(frozen=True)
class Setting:
    """``kind`` is text, number, toggle or choice; ``low`` and ``high`` bound a number, ``options`` are a
    choice's values."""

    key: str
    kind: str
    default: Any
    low: float | None = None
    high: float | None = None
    options: tuple[str, ...] = ()

    def problem(self, value: Any) -> str | None:
        """Why a value can't be used; None if it can."""
        number = isinstance(value, (int, float)) and not isinstance(value, bool)
        wanted = {"text": isinstance(value, str), "choice": isinstance(value, str), "toggle": isinstance(value, bool), "number": number}
        if not wanted[self.kind]:
            return f"{self.key}: {value!r} is no {'yes or no' if self.kind == 'toggle' else 'text' if self.kind == 'choice' else self.kind}"
        if self.kind == "choice" and value not in self.options:
            return f"{self.key}: {value!r} is none of {', '.join(self.options)}"
        if self.kind == "number" and self.low is not None and value < self.low:
            return f"{self.key}: {value:g} is below {self.low:g}"
        if self.kind == "number" and self.high is not None and value > self.high:
            return f"{self.key}: {value:g} is above {self.high:g}"
        return None


def resolved(settings: list[Setting], values: dict[str, Any]) -> tuple[dict[str, Any], list[str]]:
    """Every setting's value, its default where none is given or the one given can't be used, and what is
    wrong with the given ones, those that no setting has included."""
    problems = [p for s in settings if s.key in values and (p := s.problem(values[s.key]))]
    out = {s.key: values[s.key] if s.key in values and not s.problem(values[s.key]) else s.default for s in settings}
    keys = {s.key for s in settings}
    return out, problems + [f"{k}: no such setting" for k in values if k not in keys]
