"""Training-data operators: license scans, near-duplicates, quality rules, packing,
fingerprints, sharding, toxicity, page extraction, language-model scores, sub-words.

Nothing outside this folder imports it.
"""
