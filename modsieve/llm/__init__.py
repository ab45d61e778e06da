"""Corpus-preparation operators: extraction, de-duplication, scoring, scanning and mixing."""
