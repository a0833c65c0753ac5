"""Lodestone: retrieval, grounding and corpus operators as Spark plans."""
