"""Training-data operators: retrieval, tokenised output, fingerprints, packing, counting,
language and quality models, URL filters and near-duplicate classes.  Nothing outside this
subpackage imports it."""
