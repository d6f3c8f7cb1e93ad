"""Reading of vertex and edge tables into graphs, and writing of graphs."""
