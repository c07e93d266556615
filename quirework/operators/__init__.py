"""DataFrame transformations over documents, pages, blocks and tokens."""
