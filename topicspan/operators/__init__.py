"""DataFrame -> DataFrame steps of topic analysis."""
