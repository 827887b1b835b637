"""Set-based operators over assertions, entities, identities and graphs."""
