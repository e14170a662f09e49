"""Registered queries and their SQL."""

from . import arrays, imaging, transcription

QUERIES = transcription.QUERIES | imaging.QUERIES | arrays.QUERIES
SQL = transcription.SQL | imaging.SQL | arrays.SQL
