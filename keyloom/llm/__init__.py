"""Corpus preparation operators: deduplication, scanning, language, packing, mixing and storage of documents."""
