"""Whole queries: the model's tables, the operators applied to them, and their SQL."""

from . import documents, library, listening, pdf, positions, spoken, stored, streams, structure, texts
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "documents", "library", "listening", "pdf", "positions", "spoken", "stored", "streams", "structure", "texts"]
