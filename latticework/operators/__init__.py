"""Members, views, cross-tabs and the OLAP operators on them."""
