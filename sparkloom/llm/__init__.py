"""Operators for building training corpora: sharding, mixing, fingerprints,
vector search, tokenising, archives, licences, personal data, languages and
near duplicates.  Nothing else in the library imports this package."""
