"""Part of veldspar."""
