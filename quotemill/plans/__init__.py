"""Composed jobs and views."""
