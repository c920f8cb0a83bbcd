"""Operators for preparing text and vector corpora: review comments, reports, feature vectors and web captures."""
