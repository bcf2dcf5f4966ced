"""Operators for preparing text for language models, as jobs over a `documents` table."""
