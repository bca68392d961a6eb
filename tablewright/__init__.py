"""tablewright: preparation and staged classification of wide tables on Spark."""
