"""Similarity clustering and catalogue analytics as DataFrame operators."""
