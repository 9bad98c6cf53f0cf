"""Errors with stable codes."""


class MaskError(ValueError):
    """An error that callers tell apart by `code`."""

    def __init__(self, code: str, message: str = ""):
        super().__init__(f"{code}: {message}" if message else code)
        self.code = code
