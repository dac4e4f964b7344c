"""DataFrame-to-DataFrame operators; none collects or loops over keys."""
