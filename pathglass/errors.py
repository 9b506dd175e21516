"""Failures that a caller can act on: a stable code, a reason and a next step."""

from __future__ import annotations


class TraceError(Exception):
    def __init__(self, code: str, reason: str, next_action: str = ""):
        super().__init__(f"{code}: {reason}")
        self.code, self.reason, self.next_action = code, reason, next_action

    def as_dict(self) -> dict[str, str]:
        return {"code": self.code, "reason": self.reason, "next_action": self.next_action}


def invalid(reason: str, next_action: str = "correct the request") -> TraceError:
    return TraceError("INVALID_ARGUMENT", reason, next_action)


def not_found(reason: str, next_action: str = "list what exists") -> TraceError:
    return TraceError("NOT_FOUND", reason, next_action)


def not_ready(reason: str, next_action: str = "decode with more detail") -> TraceError:
    return TraceError("DETAIL_NOT_READY", reason, next_action)
