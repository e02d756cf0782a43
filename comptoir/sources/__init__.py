"""Reading and writing files, and the column contracts of each source."""
