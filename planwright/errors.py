"""Errors of models, rules and queries: a code, a message and, where there is one, a fix to apply."""

from __future__ import annotations


class PlanError(ValueError):
    def __init__(self, code: str, message: str, fix: str | None = None):
        super().__init__(f"{code}: {message}" + (f" (try: {fix})" if fix else ""))
        self.code, self.message, self.fix = code, message, fix
