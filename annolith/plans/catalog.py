"""Imports every module that registers queries."""

from . import annotate, composites, features, inference, retrieval, scoring, sources, text, validation  # noqa: F401
