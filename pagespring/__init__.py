"""Spark-native document transcription engine."""
