"""Writers, write-time rules and retention."""
