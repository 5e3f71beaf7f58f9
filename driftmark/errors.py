"""Errors that a user can act on; the command line prints them in one line and exits with status 2."""


class DriftError(Exception):
    """Base of all expected errors."""


class CanonicalError(DriftError):
    """A value has no canonical JSON form."""


class InputError(DriftError):
    """A data set is missing or malformed, or lacks the fields that match its records."""


class SnapshotError(DriftError):
    """A snapshot is malformed or does not fit the other side."""
