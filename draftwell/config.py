"""Tolerances, analysis settings and the settings a run captures. Lengths are in inches."""

from __future__ import annotations

import hashlib
import math
import re
from dataclasses import asdict, dataclass, field


@dataclass(frozen=True)
class Tolerance:
    """Fixed default values of the six tolerances; each must be a positive finite number."""

    duplicate: float = 1e-4
    short_edge: float = 0.5
    gap_search: float = 0.1
    coordinate_epsilon: float = 1e-6
    big_z: float = 0.01
    large_coordinate: float = 1e6

    def __post_init__(self) -> None:
        for name, value in asdict(self).items():
            if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value) or value <= 0:
                raise ValueError(f"tolerance {name} must be a positive number, not {value!r}")


@dataclass(frozen=True)
class AnalysisConfig:
    tolerance: Tolerance = field(default_factory=Tolerance)
    profile_name: str = "default"
    deepest_nesting_warning: int = 3


_STRICT = re.compile(r"\s*[+-]?(?:\d+(?:_\d+)*)(?:\.\d+(?:_\d+)*)?(?:[eE][+-]?\d+)?\s*\Z")


def strict_number(value: object) -> float | None:
    """A finite number at or above zero, given as a number or as text that is nothing but one; else None."""
    if isinstance(value, bool) or value is None:
        return None
    if isinstance(value, str):
        if not _STRICT.match(value):
            return None
        value = float(value.replace("_", ""))
    if not isinstance(value, (int, float)) or not math.isfinite(value) or value < 0:
        return None
    return float(value)


def tolerance_category(value: object) -> str:
    number = strict_number(value)
    return "invalid" if number is None else "zero" if number == 0 else "positive"


@dataclass(frozen=True)
class ExecutionConfig:
    """What a snapshot remembers of the settings in force. ``overrides`` replace values of ``tolerances``."""

    tolerances: dict
    profile_id: str = "default"
    profile_version: str = "1"
    rules_id: str = "default"
    rules_version: str = "1"
    overrides: dict = field(default_factory=dict)
    captured_at: str = ""

    @classmethod
    def from_config(cls, config: AnalysisConfig, captured_at: str = "") -> ExecutionConfig:
        return cls(tolerances=asdict(config.tolerance), profile_id=config.profile_name, captured_at=captured_at)

    @property
    def schema_version(self) -> str:
        return "tol-" + "-".join(sorted(self.tolerances))

    def value(self, name: str) -> float | None:
        """The captured tolerance or None if it is missing or unusable; there is no silent default."""
        return strict_number(self.overrides.get(name, self.tolerances.get(name)))

    def digest(self) -> str:
        parts = [f"{k}={v!r}" for k, v in sorted({**self.tolerances, **self.overrides}.items())]
        whole = "|".join([self.profile_id, self.profile_version, self.rules_id, self.rules_version, self.schema_version, *parts])
        return hashlib.sha256(whole.encode()).hexdigest()
