"""Errors of reading, mapping and writing tables."""

from __future__ import annotations


class DatasetError(Exception):
    """exit_code: what a command line ends with."""

    exit_code = 1


class UsageError(DatasetError):
    """An unsupported format, a missing dependency, a wrong mapping or configuration."""

    exit_code = 2


class DatasetIOError(DatasetError):
    exit_code = 3


class SourceError(DatasetIOError):
    pass


class SinkError(DatasetIOError):
    pass


class AddressColumnError(UsageError):
    """No single column holds the addresses; candidates are ranked (name, score)."""

    def __init__(self, message: str, candidates: list[tuple[str, float]]):
        super().__init__(message)
        self.candidates = candidates
