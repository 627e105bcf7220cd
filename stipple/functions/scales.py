"""Lists of scales: widths of square bins in pixels and in units of length. At most a dozen entries, made on the driver."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np


@dataclass(frozen=True)
class Scales:
    vox: tuple[int, ...] = field(default=())
    um: tuple[float, ...] = field(default=())

    def __len__(self) -> int:
        return len(self.vox)

    @classmethod
    def in_pixels(cls, low: int = 2, high: int = 64, n: int = 12) -> Scales:
        """Truncated logarithmic steps between two widths, each once."""
        vox = sorted({int(v) for v in np.logspace(math.log10(low), math.log10(high), n)})
        return cls(tuple(vox), tuple(map(float, vox)))

    @classmethod
    def for_extent(cls, extent: float | None, grid: int = 256, low: float = 10.0, high: float = 1000.0, n: int = 12) -> Scales:
        """Logarithmic steps of length, as whole pixels of ``extent / grid``, each once, thinned to ``n``.

        Four candidates for each wanted scale; those below 0.9 of two pixels or above
        half the grid drop out. Without an extent the steps run from 2 pixels to the
        larger of 64 and 4 n, and ``low`` and ``high`` play no part.
        """
        if extent is None:
            return cls.in_pixels(2, max(64, 4 * n), n)
        pixel = extent / grid
        wanted = [s for s in np.logspace(math.log10(low), math.log10(high), 4 * n) if s >= 1.8 * pixel]
        vox = list(dict.fromkeys(v for s in wanted if (v := max(2, int(np.rint(s / pixel)))) <= grid // 2))
        if len(vox) > n:
            vox = [vox[int(i)] for i in np.rint(np.linspace(0, len(vox) - 1, n))]
        return cls(tuple(vox), tuple(v * pixel for v in vox))

    @classmethod
    def default(cls, extent: float, grid: int = 256, n: int = 12) -> Scales:
        """From 10 to the smaller of 1000 and 0.4 of the longest side."""
        return cls.for_extent(extent, grid, 10.0, min(1000.0, 0.4 * extent), n)

    @classmethod
    def of_pixels(cls, vox: list[int], extent: float, grid: int) -> Scales:
        return cls(tuple(vox), tuple(v * (extent / grid) for v in vox))
