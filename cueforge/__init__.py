"""Subtitle and transcript analytics as Spark DataFrame transforms."""
