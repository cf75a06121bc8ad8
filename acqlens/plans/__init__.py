"""Session settings, broadcast policy, lineage cuts and the named view registry."""
