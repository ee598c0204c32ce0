"""Whole plans: from question to cited answer, and from document to index."""
