"""Delta windows: (left, right, coefficients)."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class DeltaWindow:
    left: int
    right: int
    taps: tuple[float, ...]

    def __post_init__(self):
        if self.left + self.right + 1 != len(self.taps):
            raise ValueError("a window has left + right + 1 coefficients")


# The usual windows of static, delta and delta-delta features.
STATIC = DeltaWindow(0, 0, (1.0,))
DELTA = DeltaWindow(1, 1, (-0.5, 0.0, 0.5))
DELTA2 = DeltaWindow(1, 1, (1.0, -2.0, 1.0))
WIDE_DELTA = DeltaWindow(2, 2, (1 / 12, -8 / 12, 0.0, 8 / 12, -1 / 12))
WIDE_DELTA2 = DeltaWindow(2, 2, (-1 / 12, 16 / 12, -30 / 12, 16 / 12, -1 / 12))
DEFAULT = (STATIC, DELTA, DELTA2)
