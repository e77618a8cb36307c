"""Physics as Column functions: each takes and gives Spark columns, so Catalyst compiles whole chains of them."""
