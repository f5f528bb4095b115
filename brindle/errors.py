"""The engine's exceptions."""

from __future__ import annotations


class BrindleError(Exception):
    """Root of all."""


class DatabaseError(BrindleError):
    pass


class DatabaseClosedError(DatabaseError):
    pass


class ParserError(DatabaseError):
    pass


class BinderError(DatabaseError):
    pass


class PlannerError(DatabaseError):
    pass


class ExecutionError(DatabaseError):
    pass


class ConflictError(ExecutionError):
    """Another transaction was first, or a key is there already."""


class NotSupportedError(DatabaseError):
    pass


class ProgrammingError(BrindleError):
    """The API was used wrongly."""


class DataError(BrindleError):
    """A pandas frame can't be loaded as it is."""
