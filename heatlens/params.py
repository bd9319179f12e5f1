"""Parameters shared by the classifiers."""

from __future__ import annotations

from dataclasses import dataclass

# The smoothing weight, the smallest effective slice count, the
# slice length of the fixed-interval entry and the slice count of the
# total-count entries.
DEFAULT_ALPHA = 0.05
MIN_SLICES = 5
FIXED_INTERVAL = 2624
TOTAL_SLICES = 1000


@dataclass(frozen=True)
class HeatParams:
    """What a classifier needs beyond the access table.

    ``slices`` below 2 is refused and 2..4 is raised to 5. ``digits`` rounds an
    estimate before it is ranked: partial sums arrive in any order, so without
    rounding two equal estimates could differ in the last bit and a tie could
    be cut differently from run to run.
    """

    alpha: float = DEFAULT_ALPHA
    slices: int = 100
    hot_fraction: float = 0.0005
    buckets: int = 4
    digits: int = 12

    def __post_init__(self) -> None:
        if not 0.0 < self.alpha < 1.0:
            raise ValueError(f"alpha must lie in (0, 1), got {self.alpha}")
        if self.slices < 2:
            raise ValueError(f"slices must be at least 2, got {self.slices}")
        if not 0.0 <= self.hot_fraction <= 1.0:
            raise ValueError(f"hot_fraction must lie in [0, 1], got {self.hot_fraction}")
        if self.buckets < 1:
            raise ValueError(f"buckets must be at least 1, got {self.buckets}")
        if self.digits < 1:
            raise ValueError(f"digits must be at least 1, got {self.digits}")

    @property
    def slice_count(self) -> int:
        return max(MIN_SLICES, self.slices)

    @property
    def slices_per_part(self) -> int:
        if self.buckets > self.slice_count:
            raise ValueError("a time partition needs at least one slice: buckets > slices")
        return self.slice_count // self.buckets

    def slice_size(self, rows: int) -> int:
        """Accesses per slice when ``rows`` accesses are cut into ``slices``."""
        return max(1, rows // self.slice_count)

    def budget(self, rows: int) -> int:
        """Hot-set size for ``rows`` accesses."""
        return int(rows * self.hot_fraction)
