"""Training-data operators. Nothing outside this folder (and the two entry files at the top) imports it."""
