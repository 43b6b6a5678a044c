"""Readers and writers: N-Triples, Turtle, encoded triples, partition files, graph exports, relational tables."""
