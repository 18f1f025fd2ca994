"""Named queries over the star-schema graph, with their SQL."""
