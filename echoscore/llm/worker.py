"""Objects that a Python worker keeps from one task to the next."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Hashable

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def kept(key: Hashable, build: Callable[[], object]) -> object:
    """``build()`` once per worker process. Functions sent inside tasks get new globals each time, so the objects
    hang on a module of their own."""
    store = vars(sys.modules.setdefault("_echoscore_kept", types.ModuleType("_echoscore_kept"))).setdefault("objects", {})
    if key not in store:
        store[key] = build()
    return store[key]
