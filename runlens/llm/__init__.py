"""Operators for preparing training text at scale; nothing else in runlens imports this subpackage."""
