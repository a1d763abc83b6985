"""Scalar functions: hashes, detectors, names, codecs."""
