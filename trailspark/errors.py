"""Errors that the library raises on purpose; their messages never hold a record's content."""

from __future__ import annotations


class TrailsparkError(ValueError):
    """Any of them."""


class ConfigurationError(TrailsparkError):
    """A configuration file that can't be read, or a value out of its range."""


class IngestError(TrailsparkError):
    """An input that can't be read at all."""


class HuntError(TrailsparkError):
    """A hunt that can't be planned: an empty window or an unknown name."""


class ReportError(TrailsparkError):
    """A report that can't be rendered or written."""
