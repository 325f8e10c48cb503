from gleaner.plans import flows, library, matching, production, registry, services  # all but registry register their queries on import

__all__ = ["flows", "library", "matching", "production", "registry", "services"]
