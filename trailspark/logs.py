"""Log lines as text or JSON, with credentials redacted."""

from __future__ import annotations

import json
import logging
import sys

from trailspark.functions.text import redacted


class _Line(logging.Formatter):
    def __init__(self, as_json: bool):
        super().__init__()
        self.as_json = as_json

    def format(self, record: logging.LogRecord) -> str:
        said = redacted(record.getMessage())
        if record.exc_info:
            said += "\n" + redacted(self.formatException(record.exc_info))
        at = self.formatTime(record, "%Y-%m-%dT%H:%M:%S")
        if self.as_json:
            return json.dumps({"at": at, "level": record.levelname.lower(), "from": record.name, "text": said}, ensure_ascii=False)
        return f"{at} {record.levelname:<7} {record.name}: {said}"


def configure(level: str = "WARNING", as_json: bool = False) -> logging.Logger:
    """The library's logger, writing to standard error; calling it again replaces what was set."""
    logger = logging.getLogger("trailspark")
    handler = logging.StreamHandler(sys.stderr)
    handler.setFormatter(_Line(as_json))
    logger.handlers[:] = [handler]
    logger.propagate = False
    logger.setLevel(level.upper())
    return logger
