"""Training-data operators: duplicate detection, scans, search, scoring, tokenising, formatting, mixing.

Nothing outside this subpackage imports it; it can be removed as a whole.
"""
