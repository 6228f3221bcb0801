"""Jobs that repeat over growing tables, as streams."""
