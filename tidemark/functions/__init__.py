"""Column functions: key/value predicates, sizes, tiers, addresses, hashes."""
