"""Landing feeds, warehouse tables, sinks and the synthetic feed."""
