"""Training-data operators over whole text tables; nothing outside this folder imports it."""
