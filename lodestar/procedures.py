"""Procedures and permissions: both are checked on the driver before a plan is built."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from .errors import PermissionDenied, UndefinedObject

#: What a role may be allowed; admin implies the rest.
PERMISSIONS = ("select", "insert", "update", "delete", "create_table", "drop_table", "call", "admin")


@dataclass
class Roles:
    """Permissions by role and table ("*": all); what is not granted is denied."""

    granted: set[tuple[str, str, str]] = field(default_factory=set)

    def grant(self, role: str, permission: str, table: str = "*") -> None:
        if permission not in PERMISSIONS:
            raise UndefinedObject(permission)
        self.granted.add((role, permission, table))

    def check(self, role: str, table: str, *permissions: str) -> None:
        """An upsert needs insert and update."""
        for p in permissions:
            if not any((role, q, t) in self.granted for q in (p, "admin") for t in (table, "*")):
                raise PermissionDenied(f"{role}: {p} on {table}")


@dataclass
class Procedures:
    roles: Roles
    known: dict[str, Callable] = field(default_factory=dict)

    def register(self, name: str, f: Callable) -> None:
        self.known[name] = f

    def call(self, role: str, name: str, *args: object) -> object:
        self.roles.check(role, name, "call")
        if name not in self.known:
            raise UndefinedObject(name)
        return self.known[name](*args)
