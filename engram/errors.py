"""What callers can catch. Each error has the status that a service would answer with, and whether trying again may help."""


class EngramError(Exception):
    """Base of all errors of this library."""

    status, retry = 500, False


class NotFoundError(EngramError):
    """A record, task, tool or resource that isn't there, or is archived."""

    status = 404


class ValidationError(EngramError):
    """A request that breaks a limit."""

    status = 400


class ConflictError(EngramError):
    """A task is already running, or another writer was first."""

    status, retry = 409, True


class BackpressureError(EngramError):
    """A buffer is full: write again once it was flushed."""

    status, retry = 503, True
