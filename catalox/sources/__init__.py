"""Tables, files and the sharded record store."""
