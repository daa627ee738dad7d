"""A PySpark engine for text corpora, device-state rules, evaluation metrics and numeric arrays."""
