"""Sources: case files and the workbooks in them (``cases``). Tables are read by ``spark.read``."""
