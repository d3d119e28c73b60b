"""What Python workers keep from task to task."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable
from typing import Any


def kept(key: tuple, make: Callable[[], Any]) -> Any:
    """The value made for the key, made once per Python worker; of one kind (the key's first part) the last is kept.

    Functions travel by value, so their own globals start anew with each task; this holder lives in the worker.
    """
    holder = sys.modules.setdefault("_claimforge_kept", types.ModuleType("_claimforge_kept")).__dict__
    if key not in holder:
        made = make()
        for other in [k for k in holder if isinstance(k, tuple) and k[0] == key[0]]:
            del holder[other]
        holder[key] = made
    return holder[key]
