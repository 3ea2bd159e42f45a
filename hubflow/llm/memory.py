"""Memory of Python workers, which Spark uses again for later tasks."""

import ctypes
import functools
import inspect
from collections.abc import Callable

import pyarrow as pa


def give_back() -> None:
    """What was freed goes back to the system, so a worker that waits holds no more than it needs; where the C library can't, only Arrow's part."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def lean(f: Callable) -> Callable:
    """f as a function of one group; when its arrays are gone, their memory is given back."""

    @functools.wraps(f)
    def run(*args):
        try:
            return f(*args)
        finally:
            give_back()

    run.__signature__ = inspect.signature(f)  # by which Spark tells whether f takes the key
    return run
