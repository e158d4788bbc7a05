"""Errors with SQLSTATE codes, and their translation from Spark's error classes."""

from __future__ import annotations

from pyspark.errors import PySparkException


class LodestarError(Exception):
    sqlstate = "XX000"


class TypeMismatch(LodestarError):
    sqlstate = "42804"


class NotNullViolation(LodestarError):
    sqlstate = "23502"


class UniqueViolation(LodestarError):
    sqlstate = "23505"


class PermissionDenied(LodestarError):
    sqlstate = "42501"


class UndefinedObject(LodestarError):
    sqlstate = "42704"


class InvalidDatetime(LodestarError):
    sqlstate = "22007"


class UnsupportedTrigger(LodestarError):
    sqlstate = "0A000"


class RowBudgetExceeded(LodestarError):
    sqlstate = "54000"


def sqlstate(error: Exception) -> str:
    """The code of one of our errors or of Spark's; XX000 for others."""
    if isinstance(error, LodestarError):
        return error.sqlstate
    if isinstance(error, PySparkException):
        return error.getSqlState() or "XX000"
    return "XX000"
