"""What callers can get wrong."""


class SearchError(ValueError):
    pass


class InvalidFieldValue(SearchError):
    """A filter names a value that the metadata schema doesn't declare."""


class UndeclaredCombination(SearchError):
    """A conjunction of fields that a strict schema doesn't declare."""


class DimensionMismatch(SearchError):
    pass


class DuplicateId(SearchError):
    pass


class TransactionError(SearchError):
    pass


class NotFound(SearchError):
    pass


class AlreadyExists(SearchError):
    pass


class ParseError(SearchError):
    """Where the text stops making sense: line and column count from 1."""

    def __init__(self, message: str, line: int = 0, column: int = 0):
        super().__init__(f"{message} at line {line}, column {column}" if line else message)
        self.line, self.column = line, column
