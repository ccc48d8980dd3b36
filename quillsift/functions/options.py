"""Small driver-side helpers for launching trainers on the tables made here."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from typing import Any


def global_batch(per_device: int, devices: int, accumulation: int) -> int:
    """Rows of one optimizer step."""
    return per_device * devices * accumulation


def supported(function: Callable, **options: Any) -> dict[str, Any]:
    """The options a callable knows, without those that are None."""
    names = inspect.signature(function).parameters
    return {k: v for k, v in options.items() if k in names and v is not None}
