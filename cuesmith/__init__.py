"""Cuesmith: analytics for ordered, timed, speaker-attributed text on PySpark."""
