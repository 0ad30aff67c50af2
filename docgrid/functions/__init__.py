"""Column functions: text predicates, normalisation, classification, formatting."""

from .text import *  # noqa: F401,F403
