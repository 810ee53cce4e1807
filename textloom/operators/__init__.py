"""Vectorising, clustering, describing and projecting."""
