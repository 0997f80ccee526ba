"""Reusable column expressions and id assignment."""
