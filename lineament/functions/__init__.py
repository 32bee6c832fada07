"""Column expressions over polylines and boxes."""
