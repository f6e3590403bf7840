"""Tables, literals, folders and sinks."""
