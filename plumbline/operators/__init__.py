"""What queries are made of: lexical scoring, nearness, rank fusion, groups, facets and metrics."""
