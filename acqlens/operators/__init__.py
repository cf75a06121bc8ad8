"""DataFrame operators, one per reference view / metric statement / check."""
