"""Column functions: canonical text, search tokens, digests, times, Merkle hashes."""
