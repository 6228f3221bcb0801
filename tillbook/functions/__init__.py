"""Column helpers: calendar rules, money arithmetic and text formatting."""
