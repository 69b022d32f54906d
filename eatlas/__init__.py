"""eatlas: places-and-menus analytics as Spark DataFrame jobs."""
