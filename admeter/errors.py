"""The one error type that callers are expected to catch."""


class SchemaValidationError(ValueError):
    """An ad table does not meet the column contract."""
