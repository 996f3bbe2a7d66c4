"""Jobs to run on a schedule; each module is a command line around a function that takes a session."""
