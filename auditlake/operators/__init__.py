"""Search, integrity, sharding, retention and pipeline operators over DataFrames."""
