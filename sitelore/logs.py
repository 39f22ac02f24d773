"""Log lines of the driver in JSON, in a file that is turned over by size."""

from __future__ import annotations

import json
import logging
from logging.handlers import RotatingFileHandler

LOG = logging.getLogger("sitelore")
# Bytes of a log file, and how many older ones are kept.
SIZE, KEPT = 10_000_000, 5


class Lines(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        line = {"time": self.formatTime(record, "%Y-%m-%dT%H:%M:%S"), "level": record.levelname, "logger": record.name, "message": record.getMessage(), **getattr(record, "fields", {})}
        if record.exc_info:
            line["exception"] = self.formatException(record.exc_info)
        return json.dumps(line, ensure_ascii=False, default=str)


def to_file(path: str, *, size: int = SIZE, kept: int = KEPT) -> logging.Logger:
    """The package's logger, which writes to ``path`` from now on."""
    handler = RotatingFileHandler(path, maxBytes=size, backupCount=kept, encoding="utf-8")
    handler.setFormatter(Lines())
    for old in [h for h in LOG.handlers if isinstance(h, RotatingFileHandler)]:
        LOG.removeHandler(old)
        old.close()
    LOG.addHandler(handler)
    LOG.setLevel(logging.INFO)
    return LOG
