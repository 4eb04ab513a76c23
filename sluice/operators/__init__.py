"""Changes, targets, schemas, maintenance and operational queries."""
