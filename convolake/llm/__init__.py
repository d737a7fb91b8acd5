"""Training-data operators (fingerprints, dedup, classifiers, tokenizers, ...).

Nothing outside this subpackage imports it; ``__spark_entry__.py`` adds its
queries only when it is present.
"""
