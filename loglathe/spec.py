"""What to extract and how to arrange it: specs, lines and panels (driver-side configuration)."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass, field as dataclass_field

from .functions import patterns

FIELD, VALUE, COUNT, DELTA = "field", "value", "count", "delta"


@dataclass(frozen=True, kw_only=True)
class _Spec:
    guard: str | None = None

    kind = ""
    measure = "value"
    _title_word = ""

    @property
    def raw(self) -> str:
        """The pattern as the user wrote it."""
        return self.pattern

    @property
    def regex(self) -> str:
        return self.pattern

    @property
    def constant(self) -> float | None:
        """The value every match yields; None if it is read from the line."""
        return 1.0

    @property
    def spec_id(self) -> str:
        """Identity of the extraction; specs that extract the same records share it."""
        what = ("number",) if self.constant is None else ("event", repr(self.constant))
        parts = (*what, "" if self.guard is None else f"={self.guard}", self.regex)
        return hashlib.sha256("\x1f".join(parts).encode()).hexdigest()[:16]

    @property
    def title(self) -> str:
        return " ".join(filter(None, [self._title_word, self.guard, self.raw]))


@dataclass(frozen=True)
class FieldValue(_Spec):
    """A number read from the line: a field name (``name=1.5ms``) or a regex with 1-2 groups."""

    field: str
    kind = FIELD
    _title_word = "value of"

    @property
    def raw(self) -> str:
        return self.field

    @property
    def regex(self) -> str:
        return patterns.field_regex(self.field)

    @property
    def constant(self) -> None:
        return None


@dataclass(frozen=True)
class EventValue(_Spec):
    """A constant for every matching line."""

    pattern: str
    yvalue: float = 1.0
    kind = VALUE
    _title_word = "presence of"

    @property
    def constant(self) -> float:
        return float(self.yvalue)


@dataclass(frozen=True)
class EventCount(_Spec):
    """The running number of matching lines."""

    pattern: str
    kind = COUNT
    measure = "count"
    _title_word = "count of"


@dataclass(frozen=True)
class EventDelta(_Spec):
    """Milliseconds since the previous matching line."""

    pattern: str
    kind = DELTA
    measure = "delta"
    _title_word = "delta"


@dataclass(frozen=True)
class Line:
    """A spec placed in a panel: bound to a file by name or input index, or to every input."""

    spec: _Spec
    file_name: str | None = None
    file_id: int | None = None
    title: str | None = None
    yaxis: str = "y"

    def __post_init__(self):
        if self.yaxis not in ("y", "y2"):
            raise ValueError(f"yaxis must be 'y' or 'y2', not {self.yaxis!r}")

    @property
    def bound(self) -> bool:
        return self.file_name is not None or self.file_id is not None


@dataclass(frozen=True)
class Panel:
    lines: Sequence[Line] = dataclass_field(default_factory=tuple)
    title: str | None = None
    range_mode: str = "full"

    def __post_init__(self):
        if self.range_mode not in ("full", "best-fit"):
            raise ValueError(f"range_mode must be 'full' or 'best-fit', not {self.range_mode!r}")
