"""Readers: transcripts and event tables as ordered, timed token DataFrames."""
