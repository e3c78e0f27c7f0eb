"""Operators for preparing training text. Nothing else in quillmesh imports this subpackage."""
