"""Exceptions of the engine."""


class Error(Exception):
    """Base of all errors raised here."""


class InputError(Error):
    """The inputs of an operator don't fit it."""

    def __init__(self, expression: str, message: str) -> None:
        super().__init__(f"{expression}: {message}")
        self.expression, self.message = expression, message


class TransitionError(Error):
    """A step from one state to another that isn't allowed."""

    def __init__(self, previous: str, following: str, message: str) -> None:
        super().__init__(f"{previous} -> {following}: {message}")
        self.previous, self.following, self.message = previous, following, message
