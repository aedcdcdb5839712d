"""Nothing here yet: the operators are batch operators and have no streaming semantics to keep."""
