"""Named metrics, one function each, and the name registry."""
