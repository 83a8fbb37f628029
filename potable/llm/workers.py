"""Freed memory of Python workers goes back to the machine.

A worker process stays for the next task, and its allocators keep what arrays and
strings have freed. Several workers share an executor's memory, so each function
that works on whole texts gives the free pages back when it is done.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def over_batches(fn: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    def run(batches: Iterator) -> Iterator:
        try:
            yield from fn(batches)
        finally:
            give_back()

    return run


def over_group(fn: Callable) -> Callable:
    """For functions of one table."""

    def run(table):
        try:
            return fn(table)
        finally:
            give_back()

    return run


def over_pair(fn: Callable) -> Callable:
    """For functions of a key and a table, or of two tables."""

    def run(first, second):
        try:
            return fn(first, second)
        finally:
            give_back()

    return run
