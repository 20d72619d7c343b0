"""Modules that register queries."""

from . import boxes, files, gates, libraries, matches, patterns, relational, scalars, streams, summaries, texts, trees

MODULES: list = [scalars, relational, texts, summaries, gates, libraries, files, boxes, trees, matches, patterns, streams]
