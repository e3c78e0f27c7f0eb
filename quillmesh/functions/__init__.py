"""Subpackage of quillmesh."""
