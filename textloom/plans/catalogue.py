"""Importing the query modules fills the registry."""

from textloom.plans import corpus, judging, models, runs, tokens  # noqa: F401
from textloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
