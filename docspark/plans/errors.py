"""Located query errors."""

from __future__ import annotations


class QueryError(ValueError):
    """loc is (line, column) or None; reason a short code; the text says both."""

    def __init__(self, reason: str, text: str, loc: tuple[int, int] | None = None):
        self.reason, self.loc = reason, loc
        where = f"line {loc[0]} column {loc[1]}: " if loc else ""
        super().__init__(where + text)


def syntax(text: str, loc: tuple[int, int] | None) -> QueryError:
    return QueryError("syntax", f"syntax error: {text}", loc)
