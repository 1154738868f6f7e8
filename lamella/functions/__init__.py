"""Column expressions: normalising, blending, geometry helpers, loss kernels and vector arithmetic."""

from lamella.functions.scalar import *  # noqa: F403
