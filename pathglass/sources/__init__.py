"""Readers: table files, trace text, binary bundles, and the star tables as traces."""
