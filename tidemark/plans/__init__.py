"""State, catch-up loops and leases: what runs on the driver."""
