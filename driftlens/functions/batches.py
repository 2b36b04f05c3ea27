"""Python over the rows of one Arrow batch."""

from __future__ import annotations

import gc
import sys
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import cloudpickle

# The function travels with its code, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@contextmanager
def uncollected() -> Iterator[None]:
    """No search for cycles while a batch is read: what is listed there holds none, and every search would visit all of it
    again. Whatever else has formed cycles is found after the batch."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()
