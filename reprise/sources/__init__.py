"""Reading ticket files and tables, and writing tables that can be replaced or merged by key."""
