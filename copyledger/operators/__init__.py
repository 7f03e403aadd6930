"""DataFrame operators over catalogs and manifests."""
