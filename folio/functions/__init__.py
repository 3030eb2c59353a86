"""Part of folio, versioned-text analytics on Spark."""
