"""What iterative fits share."""

from __future__ import annotations

import warnings


class NotConverged(RuntimeWarning):
    """A fit used up its steps; ``warnings.simplefilter("error", NotConverged)`` makes it an error."""


def stopped(fit: str, steps: int) -> None:
    """Tell the caller that the estimates are those of the last step, not of an optimum."""
    warnings.warn(f"{fit} has not converged after {steps} steps", NotConverged, stacklevel=3)
