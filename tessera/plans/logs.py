"""Logs as one JSON object a line, with the run and the stage on every record, to the console and to files that rotate."""

from __future__ import annotations

import json
import logging
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from logging.handlers import RotatingFileHandler

_bound: ContextVar[dict] = ContextVar("tessera_log_fields", default={})  # noqa: B039


@contextmanager
def bound(**fields: object) -> Iterator[None]:
    """Records that are logged within carry the fields; inner ones win."""
    token = _bound.set(_bound.get() | fields)
    try:
        yield
    finally:
        _bound.reset(token)


class JsonLines(logging.Formatter):
    """A message that is a dict gives fields of its own."""

    def format(self, record: logging.LogRecord) -> str:
        said = record.msg if isinstance(record.msg, dict) else {"message": record.getMessage()}
        more = {"error": self.formatException(record.exc_info)} if record.exc_info else {}
        head = {"time": self.formatTime(record), "level": record.levelname, "logger": record.name}
        return json.dumps(head | _bound.get() | said | more, default=str, ensure_ascii=False)


def configure(file: str | None = None, level: int = logging.INFO, max_bytes: int = 10_000_000, files: int = 5) -> None:
    """Handlers of the library's logger; a second call replaces the first one's."""
    log = logging.getLogger("tessera")
    for h in list(log.handlers):
        log.removeHandler(h)
        h.close()
    handlers: list[logging.Handler] = [logging.StreamHandler()]
    if file:
        handlers.append(RotatingFileHandler(file, maxBytes=max_bytes, backupCount=files, encoding="utf-8"))
    for h in handlers:
        h.setFormatter(JsonLines())
        log.addHandler(h)
    log.setLevel(level)
    log.propagate = False
