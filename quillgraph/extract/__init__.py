"""Extractors: source trees to node and edge frames.

An extractor takes (files, graph), where files is a corpus of (path, content) and graph the
frames made so far by label and edge name, and returns new frames by name. Parsers run in
parallel over files; names are resolved by joins.
"""
