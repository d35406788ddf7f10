"""Column expressions over components: phase-space scalars, metrics, mixture densities, schedules and units."""
