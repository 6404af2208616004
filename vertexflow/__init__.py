"""Spark-native operators for point clouds, meshes, spectra and correspondences."""
