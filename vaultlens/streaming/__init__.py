"""The operators driven by arriving files.

Every stream takes its checkpoint folder from the caller. With
``availableNow`` a stream works off what has arrived and ends.
"""
