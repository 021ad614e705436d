"""Errors with a code, a message for the user and a hint; and retries."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import TypeVar

R = TypeVar("R")


class EngineError(Exception):
    code, user_message, hint = "internal", "Something went wrong.", "Try again."


class ValidationError(EngineError):
    code, user_message, hint = "validation", "Some of the values aren't valid.", "Check the marked values."


class NotFoundError(EngineError):
    code, user_message, hint = "not_found", "There is no such item.", "It may have been removed."


class StorageError(EngineError):
    code, user_message, hint = "db", "The tables can't be written now.", "Try again in a moment."


class ConflictError(StorageError):
    """Another writer's commit came first."""


class DuplicateError(EngineError):
    code, user_message, hint = "duplicate", "This id is taken.", "Choose another id."


class ConnectorError(EngineError):
    code, user_message, hint = "connector", "A source can't be set up.", "Check its connector and parameters."


class FetchError(EngineError):
    code, user_message, hint = "fetch", "A source can't be reached.", "It is tried again at the next run."


def with_retry(f: Callable[[], R], retries: int = 4, base_delay: float = 0.05, retry_on: tuple[type[BaseException], ...] = (Exception,), sleep: Callable[[float], None] = time.sleep) -> R:
    """f's result; of failures in retry_on, `retries` are tried again, each after twice the last one's delay."""
    for attempt in range(retries):
        try:
            return f()
        except retry_on:
            sleep(base_delay * 2**attempt)
    return f()
