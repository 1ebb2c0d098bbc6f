"""Errors of the engine."""

from __future__ import annotations


class EngineError(Exception):
    """Base of all errors that the engine raises itself."""


class ParseError(EngineError):
    """A statement that can't be read."""


class SemanticError(EngineError):
    """A statement that names what doesn't exist or doesn't fit."""


class DuplicateError(SemanticError):
    """A table, column or index that exists already."""


class ExecutionError(EngineError):
    """A statement that failed while it ran."""
