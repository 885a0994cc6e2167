"""Where vectors and indices come from and go to: tables in shared storage, saved indices, synthetic data."""
