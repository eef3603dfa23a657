"""Retrieval and ranking over peak lists, as DataFrame operators on Spark."""
