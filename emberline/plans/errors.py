"""What can be wrong with a rule."""

from __future__ import annotations


class RuleError(ValueError):
    """Any error in a rule."""


class SyntaxProblem(RuleError):
    """The text is no rule."""

    def __init__(self, message: str, at: int = -1):
        super().__init__(message if at < 0 else f"{message} (at character {at})")
        self.at = at


class UnknownEventType(RuleError):
    """The schema has no such event type."""


class UnknownField(RuleError):
    """The schema has no such field."""


class TypeMismatch(RuleError):
    """An operator or function got a type it can't take."""


class UnknownFunction(RuleError):
    """There is no function of that name, or it takes other arguments."""


class InvalidRule(RuleError):
    """The parts of a rule don't fit together."""
