"""loamgrid: grid, vector, text-catalogue and model operators as Spark plans."""
