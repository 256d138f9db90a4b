"""Span analytics over annotated text, expressed as Spark DataFrame plans."""
