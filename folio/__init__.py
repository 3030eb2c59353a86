"""folio: versioned, hierarchical text analytics expressed as Spark DataFrame plans."""
