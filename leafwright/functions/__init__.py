"""Column functions: text, replies and names. All are Catalyst expressions but the entity decoder."""
