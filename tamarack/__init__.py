"""Tamarack: retrieval and conversation analytics as Spark DataFrame plans."""
