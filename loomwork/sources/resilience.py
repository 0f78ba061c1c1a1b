"""Calls to outside services: retries with growing waits, and a breaker that stops calling what keeps failing."""

from __future__ import annotations

import random
import time
from collections.abc import Callable


class OpenError(RuntimeError):
    """The breaker is open."""


def retry(call: Callable, attempts: int = 4, wait: float = 0.5, factor: float = 2.0, jitter: float = 0.1, errors: tuple = (OSError,), sleep=time.sleep):
    for k in range(attempts):
        try:
            return call()
        except errors:
            if k == attempts - 1:
                raise
            sleep(wait * factor**k * (1 + jitter * random.random()))
    raise ValueError("at least one attempt is needed")


class Breaker:
    """Opens after `limit` failures in a row; after `rest` seconds one call may try again."""

    def __init__(self, limit: int = 5, rest: float = 30.0, clock=time.monotonic):
        self.limit, self.rest, self.clock, self.failures, self.opened = limit, rest, clock, 0, None

    def call(self, f: Callable):
        if self.opened is not None and self.clock() - self.opened < self.rest:
            raise OpenError("too many failures")
        try:
            got = f()
        except Exception:
            self.failures += 1
            if self.failures >= self.limit:
                self.opened = self.clock()
            raise
        self.failures, self.opened = 0, None
        return got
