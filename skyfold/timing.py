"""How long a call takes."""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import wraps
from typing import Any


def timed(function: Callable) -> Callable:
    """The function with one more keyword, ``timing``: if true, its seconds are printed. A plan's own time is that of its action."""

    @wraps(function)
    def inner(*args: Any, timing: bool = False, **more: Any) -> Any:
        if not timing:
            return function(*args, **more)
        start = time.perf_counter()
        out = function(*args, **more)
        print(f"{function.__qualname__}: {time.perf_counter() - start:.6f} s")
        return out

    return inner
