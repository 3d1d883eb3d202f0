"""The one exception the package raises for requests it cannot serve."""

from __future__ import annotations


class RequestError(ValueError):
    """A request that names an unknown column, option or operation."""

    def __init__(self, message: str, code: str) -> None:
        super().__init__(message)
        self.code = code
