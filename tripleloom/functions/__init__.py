"""Column functions over RDF terms and XML Schema lexical forms."""
