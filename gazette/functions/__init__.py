"""Part of the gazette article-feed analytics engine."""
