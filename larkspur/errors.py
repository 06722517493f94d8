"""Errors with a code and a status, and their envelope."""

from __future__ import annotations

import uuid

from larkspur.settings import SETTINGS


class ServiceError(Exception):
    def __init__(self, code: str, message: str, status: int = 400, details: dict | None = None) -> None:
        super().__init__(message)
        self.code, self.message, self.status, self.details = code, message, status, details or {}

    def envelope(self, safe: bool = True) -> dict:
        """What a caller sees; in safe mode without the details of server errors."""
        error = {"code": self.code, "message": self.message, "details": {} if safe and self.status >= 500 else self.details}
        return {"schema_version": SETTINGS.schema_version, "request_id": str(uuid.uuid4()), "error": error}


def unexpected(e: Exception, safe: bool = True) -> dict:
    """The envelope of any other exception."""
    return ServiceError("internal_error", "Unexpected server error", 500, {"exception_type": type(e).__name__}).envelope(safe)
