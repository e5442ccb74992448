"""User-level DataFrame operators (profile, clean, roll up, features, ...)."""
