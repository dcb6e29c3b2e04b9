"""Corpus-preparation operators for training data: deduplication, quality rules, mixing,
decontamination, language-model scoring, formatting, token output and licence scans.

Nothing outside this subpackage imports it.
"""
