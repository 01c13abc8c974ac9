"""Stable classes of failure, which reports carry by name."""


class LedgerError(Exception):
    error_class = "io"


class InvalidInput(LedgerError):
    error_class = "invalid_input"


class Corruption(LedgerError):
    error_class = "corruption"


class UnsupportedVersion(LedgerError):
    error_class = "unsupported_version"
