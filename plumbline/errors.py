"""Errors carry a stable code, so that callers can tell them apart without reading messages."""


class QueryError(ValueError):
    """A request that cannot be run as asked: unknown field, wrong type, bad paging and so on."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code
        self.message = message


class Damaged(ValueError):
    """Stored data that does not read back whole."""
