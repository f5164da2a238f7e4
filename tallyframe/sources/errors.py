"""Errors of the readers."""


class MatrixParseError(ValueError):
    """A malformed matrix file."""


class LayoutError(ValueError):
    """A folder or file that lacks a part its format needs."""


class MissingLibrary(ImportError):
    """An optional library that a format needs is not installed."""
