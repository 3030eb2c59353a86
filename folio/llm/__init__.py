"""Operators that prepare training data; nothing else in folio imports this subpackage."""
