"""Errors of the table layer."""


class TableError(Exception):
    """Any failure of a managed table."""


class Corrupt(TableError):
    """A commit or data file is not what its checksum or place says."""


class WriterLocked(TableError):
    """Another writer committed first, again and again."""


class SchemaMismatch(TableError):
    """Rows or a column do not fit the table's schema."""


class Unsupported(TableError, NotImplementedError):
    """A statement that the table layer does not carry out."""


class InvalidArgument(TableError, ValueError):
    """An option or argument that cannot be."""


class ReadOnly(TableError):
    """A write through a table that was opened to be read."""
