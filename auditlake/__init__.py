"""Audit logs on Spark: versioned entities, time-travel queries, Merkle proofs, retention and sharding."""
