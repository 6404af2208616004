"""Part of vertexflow; see README.md."""
