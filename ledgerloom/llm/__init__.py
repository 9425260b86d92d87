"""Operations of a training-data pipeline: archives, scans, near copies, leaks, extraction, scoring, mixing.

Nothing else in the library imports this subpackage.
"""
