"""General data-preparation operators."""
