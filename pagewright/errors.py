"""Errors raised while a query is planned, on the driver."""


class PagewrightError(Exception):
    """Base of this package's errors."""


class ParseError(PagewrightError, TypeError):
    """The input can't be parsed as HTML."""


class SelectorError(PagewrightError, ValueError):
    """A selector is malformed or uses what isn't supported."""


class ExtractError(PagewrightError, ValueError):
    """An extraction schema is malformed."""


class FormatError(PagewrightError, ValueError):
    """Data doesn't fit the output format."""
