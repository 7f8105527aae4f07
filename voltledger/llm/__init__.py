"""Operators for preparing training text: tokens, scans, scores, mixing and near-duplicates."""
