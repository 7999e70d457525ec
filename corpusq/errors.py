"""Errors. Their codes are those of the session interface."""

from __future__ import annotations


class CorpusError(Exception):
    code = 1000


class ParseError(CorpusError):
    code = 1100

    def __init__(self, position: int, message: str):
        super().__init__(f"{message} (at {position})")
        self.position, self.message = position, message


class UnknownLabel(CorpusError):
    code = 1101

    def __init__(self, label: str):
        super().__init__(f"no label {label} in the query")
        self.label = label


class ExecutionError(CorpusError):
    code = 1102


class UnknownLayer(CorpusError):
    code = 1103


class NotFound(CorpusError):
    code = 1104


class Ambiguous(CorpusError):
    code = 1105


class BadRange(CorpusError):
    code = -32602


class FormatError(CorpusError):
    code = 1106


class VersionMismatch(CorpusError):
    code = 1107


class UnknownHandle(CorpusError):
    code = 1200


class NameInUse(CorpusError):
    code = 1201


class UnknownName(CorpusError):
    code = 1202


class PageTooLarge(CorpusError):
    code = 1203


class StaleQuery(CorpusError):
    code = 1204


class AlreadyMaterialized(CorpusError):
    code = 1205


class UnknownAlignment(CorpusError):
    code = 1300


class OutsideSource(CorpusError):
    code = 1301


class IncompatibleCoupler(CorpusError):
    code = 1400


class UnknownCoupler(CorpusError):
    code = 1401


class CouplerCycle(CorpusError):
    code = 1402


class UnsupportedCoupler(CorpusError):
    code = 1403


class UnknownClient(CorpusError):
    code = 1500


class UnknownTopic(CorpusError):
    code = 1600
