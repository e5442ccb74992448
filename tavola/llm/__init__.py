"""Training-data operators: de-duplication, quality, packing, privacy,
language-model scoring, extraction, tokenisation and licence scans.

Nothing else in the library imports this subpackage.
"""
