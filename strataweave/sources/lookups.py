"""Literal lookup values."""

# Postal codes of the 48 conterminous states.
CONTERMINOUS_STATES = (
    "AL", "AZ", "AR", "CA", "CO", "CT", "DE", "FL", "GA", "ID", "IL", "IN", "IA", "KS", "KY", "LA",
    "ME", "MD", "MA", "MI", "MN", "MS", "MO", "MT", "NE", "NV", "NH", "NJ", "NM", "NY", "NC", "ND",
    "OH", "OK", "OR", "PA", "RI", "SC", "SD", "TN", "TX", "UT", "VT", "VA", "WA", "WV", "WI", "WY",
)

# Geographic study window (degrees), buffer radius (metres), sampling sizes and seeds.
STUDY_WINDOW = (-125.0, 24.0, -66.0, 49.0)
BUFFER_RADIUS_M = 1000.0
STRATUM_ROWS = 1000
RESAMPLE_SEEDS = (1, 5, 10)
ENTITY_ROWS, ENTITY_SEED = 12, 42
FIT_LIMITS = (10.0, 80.0)
