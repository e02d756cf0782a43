"""Import every registry module once, so that all queries are registered."""

from comptoir.registry import cleaning, controls, facts, fuzzy, mobile, portfolio  # noqa: F401
