"""tillbook: retail analytics and batch upkeep as PySpark DataFrame functions."""
