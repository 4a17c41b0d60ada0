"""Functions from columns to columns: all run inside the JVM, none is a Python UDF unless it says so."""
