"""Operators for training text: normal forms, linkage without keys, personal data, encoding, leakage, languages."""
