"""Column expressions: keyed digests, identifiers, format-preserving encryption, detectors, safe expressions."""
