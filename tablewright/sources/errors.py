"""What can go wrong when a file is read."""


class IngestionError(Exception):
    """Any problem with an input file."""


class UnsupportedFormat(IngestionError):
    pass


class CorruptedFile(IngestionError):
    pass


class EmptyTable(IngestionError):
    pass


class EncodingError(IngestionError):
    pass


class InvalidJson(IngestionError):
    pass


class MissingColumns(IngestionError):
    pass


class Unavailable(IngestionError):
    """The format or service needs a library that is not installed."""
