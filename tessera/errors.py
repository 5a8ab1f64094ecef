"""Errors, by what failed."""


class TesseraError(Exception):
    """Any error of this library."""


class LanguageNotFoundError(TesseraError):
    """A name that is neither a language nor an alias."""


class ConfigError(TesseraError):
    """A configuration that cannot be read."""


class ParseFailedError(TesseraError):
    """A text that cannot be parsed."""


class QueryError(TesseraError):
    """A query text that cannot be compiled."""


class InvalidRangeError(TesseraError):
    """A byte range outside its text."""


class DownloadError(TesseraError):
    """Something asked for that cannot be fetched."""


class ChecksumMismatchError(DownloadError):
    """Content whose digest is not the one expected."""
