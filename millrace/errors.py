"""Errors of the engine with their SQLSTATE."""

from __future__ import annotations


class EngineError(Exception):
    sqlstate = "XX000"
    fatal = False


class InvalidIdent(EngineError):
    sqlstate = "42601"


class InvalidSchema(EngineError):
    sqlstate = "42601"


class InvalidLiteral(EngineError):
    sqlstate = "42601"


class Unsupported(EngineError):
    sqlstate = "42601"


class NotFound(EngineError):
    sqlstate = "42704"


class AlreadyExists(EngineError):
    sqlstate = "42704"


class CommitConflict(EngineError):
    sqlstate = "40001"


class IsolationViolation(EngineError):
    fatal = True


class Denied(EngineError):
    sqlstate = "28000"
    fatal = True


class TooMany(EngineError):
    sqlstate = "53300"
