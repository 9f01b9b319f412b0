"""DataFrame operators over triples: matching, paths, inference, resolution."""
