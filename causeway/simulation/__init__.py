"""The generator: registries, schedule, events, instances."""
