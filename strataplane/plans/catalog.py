"""All queries by name, with their SQL."""

from __future__ import annotations

from strataplane.plans import auxiliary, containers, containers_wide, headers, images, kernels, more, motion, pixels, programs, relations, syntax, tiles  # noqa: F401
from strataplane.plans.base import ORACLE, QUERIES

FLAGSHIP = "yuv420_to_rgb_bt601"

__all__ = ["FLAGSHIP", "ORACLE", "QUERIES"]
