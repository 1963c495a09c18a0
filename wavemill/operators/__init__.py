"""Relational operators over signals, codes and dictionaries."""
