"""Operators of a training-data pipeline (tokenising, scanning, filtering, mixing, de-duplication).

Nothing else in the library imports this subpackage; the top-level entry file
adds its queries only if it is there.
"""
