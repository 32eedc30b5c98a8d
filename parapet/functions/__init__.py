"""Part of parapet."""
