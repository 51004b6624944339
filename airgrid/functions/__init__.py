"""Column builders: everything here stays inside Catalyst, no Python UDF."""
