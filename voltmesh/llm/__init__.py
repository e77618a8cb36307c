"""Training-data operators: sharding, tokenising, deduplication, filtering, archives.

Each module holds one operator; ``registry`` lists the queries and their oracle SQL. Nothing outside this
subpackage imports it.
"""
