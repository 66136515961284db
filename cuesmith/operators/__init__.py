"""Operators on token, group, event and cue DataFrames."""
