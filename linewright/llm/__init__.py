"""Training-data operators: token counts, language-model scores, packing, fingerprints, language, quality, HTML, toxicity, mixing, near duplicates."""
