"""attestor: evidence-backed retrieval and retrieval evaluation as PySpark DataFrame operators."""
