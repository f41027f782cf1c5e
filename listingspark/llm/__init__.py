"""Training-data operators: near and substring deduplication, fingerprints, packing, token files, language, extraction,
chat formatting, quality rules and subword encoding.  Nothing else in the library imports this package."""
