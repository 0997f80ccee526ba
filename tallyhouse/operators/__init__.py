"""Domain operators of the ledger (DataFrame -> DataFrame)."""
