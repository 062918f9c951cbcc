"""Named analyses over the star schema and the audit tables."""
