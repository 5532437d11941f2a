"""Errors raised by the audit."""


class AuditError(Exception):
    """The chain cannot be audited: no joins, unknown names, a failing input."""
