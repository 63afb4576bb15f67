"""folioforge: document-analysis operators expressed as Spark DataFrame plans."""
