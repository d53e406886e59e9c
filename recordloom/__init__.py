"""Record curation and data-governance analytics as PySpark DataFrame jobs."""
