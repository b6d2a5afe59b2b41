"""Settings of detection as an immutable value that builders take; a change gives a new value."""

from __future__ import annotations

import warnings
from dataclasses import asdict, dataclass, fields, replace


@dataclass(frozen=True)
class Detection:
    """Thresholds of the ladder, by name."""

    strong_script: float = 50
    mixed_least: float = 20
    mixed_most: float = 50
    minor_least: float = 5
    minor_most: float = 20
    latin_dominance: float = 70
    model_sure: float = 0.95
    model_mixed: float = 0.5
    model_high: float = 0.8
    model_medium: float = 0.6
    model_override: float = 0.9
    ensemble_least: float = 0.65
    ensemble_early: float = 0.85
    romanized_early: float = 0.75
    romanized_early_short: float = 0.85
    early_length: int = 8

    def updated(self, **changes: float) -> Detection:
        """These settings with changes; a name that there isn't is warned of and left out."""
        known = {f.name for f in fields(self)}
        for name in set(changes) - known:
            warnings.warn(f"no such setting: {name}", stacklevel=2)
        return replace(self, **{k: v for k, v in changes.items() if k in known})

    def shown(self) -> dict[str, float]:
        return asdict(self)
