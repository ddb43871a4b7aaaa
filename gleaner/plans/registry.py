"""All registered queries."""

from . import contents, extraction, feedback, reading, scheduling, stages, structure, text  # noqa: F401
from .inputs import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
