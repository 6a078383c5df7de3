"""tesserae: graph-based retrieval analytics expressed as Spark DataFrame plans."""
