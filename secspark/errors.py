"""Errors with codes; ``recoverable`` says whether a retry can help."""


class SecsparkError(Exception):
    code, recoverable = "INTERNAL", False


class InvalidQuery(SecsparkError, ValueError):
    code = "INVALID_QUERY"


class InvalidRecord(SecsparkError, ValueError):
    code = "INVALID_RECORD"


class IntegrityError(SecsparkError):
    code = "INTEGRITY"


class StorageError(SecsparkError):
    code, recoverable = "STORAGE", True
