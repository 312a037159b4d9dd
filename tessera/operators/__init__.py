"""Set-oriented operators over DataFrames: allocation, tallies, reconciliation, spans, sweeps."""
