"""Training-data operators: language ID, licences, quality, deduplication,
token rollups, decontamination, mixing and toxicity.

Nothing else in the library imports this subpackage."""
