"""Operators on texts of training corpora; nothing outside imports this subpackage."""
