"""DataFrame operators over item catalogs."""
