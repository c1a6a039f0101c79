"""Column expressions: no joins, no state, whole-stage codegen only."""
