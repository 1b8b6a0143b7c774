"""shoebox: analytics over large media libraries, declared as Spark DataFrame plans."""
