"""What can go wrong at a system's side, and whether it is worth another try."""

from __future__ import annotations


class SystemError_(Exception):
    """An answer of a system that is no success."""

    retryable = False


class Unreachable(SystemError_):
    """No answer, or one that says to come back."""

    retryable = True


class TooMany(Unreachable):
    """Asked too often; ``after`` has the seconds to wait, where they are known."""

    def __init__(self, message: str = "", after: float | None = None):
        super().__init__(message)
        self.after = after


class NotAllowed(SystemError_):
    """Credentials are missing, wrong, or not enough."""


class Refused(SystemError_):
    """The record itself is not accepted."""


class BreakerOpen(Unreachable):
    """Too many of the last passes failed."""
