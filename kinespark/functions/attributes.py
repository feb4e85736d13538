"""Values of file attributes as plain Python."""

from __future__ import annotations

import numpy as np


def plain(value: object) -> object:
    """Bytes to text (bad bytes replaced), arrays to lists, numpy scalars to Python, all of it nested; the rest as it is."""
    if isinstance(value, np.ndarray) and value.ndim:
        return [plain(x) for x in value.tolist()]
    if isinstance(value, bytes):
        return str(value, "utf-8", "replace")
    if isinstance(value, (np.ndarray, np.generic)):
        return plain(value.item())
    return value
