"""Relational operators over points, sparse matrices, meshes, surfaces, metrics and correspondences."""
