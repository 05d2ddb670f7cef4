"""Round schedules and lineage cuts."""
