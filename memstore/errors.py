"""Errors that the engine raises."""


class MemoryStoreError(Exception):
    """Base of all errors below."""


class DimensionMismatch(MemoryStoreError):
    def __init__(self, expected: int, got: int):
        super().__init__(f"expected {expected} dimensions, got {got}")
        self.expected, self.got = expected, got


class NotFound(MemoryStoreError):
    pass


class Invalid(MemoryStoreError):
    pass


class ReadOnlyError(MemoryStoreError):
    pass


class Locked(MemoryStoreError):
    """Another writer committed first."""


class WrongPassphrase(MemoryStoreError):
    pass


class Tampered(MemoryStoreError):
    """A sealed value doesn't open."""


class Corrupt(MemoryStoreError):
    pass


class UnsupportedVersion(MemoryStoreError):
    pass


class NeedsWriteOpen(MemoryStoreError):
    pass
