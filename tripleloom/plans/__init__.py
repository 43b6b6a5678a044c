"""SPARQL front end, statistics, join ordering and summary pruning."""
