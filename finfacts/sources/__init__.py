"""Reading and writing facts, sheets and table grids."""
