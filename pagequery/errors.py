"""What the engine raises; every error tells its context as fields."""

from __future__ import annotations


class EngineError(Exception):
    """Base of all: a message and named facts."""

    def __init__(self, message: str, **context):
        super().__init__(message)
        self.message, self.context = message, context

    def __str__(self) -> str:
        facts = ", ".join(f"{k}={v!r}" for k, v in sorted(self.context.items()))
        return f"{self.message} ({facts})" if facts else self.message


class ConfigError(EngineError, ValueError):
    """A setting is unknown or has a bad value."""


class FetchError(EngineError):
    """A page could not be had."""


class FetchTimeout(FetchError, TimeoutError):
    """The page took too long."""


class BlockedError(FetchError):
    """A bot check or a refusal came in place of the page."""


class ParseError(EngineError, ValueError):
    """Text is not of the format it should have."""


class SelectorError(ParseError):
    """A selector or path can't be read."""


class SchemaError(ParseError):
    """A schema can't be read."""


class ExtractionError(EngineError):
    """No plan and no model gave the records that were asked for."""


class ModelError(EngineError):
    """A model's call failed."""


class ModelAuthError(ModelError):
    """The model refused the credentials; asking again is no use."""


class StateError(EngineError):
    """A state table can't be read or written."""


class OutputError(EngineError):
    """A sink refused the rows."""
