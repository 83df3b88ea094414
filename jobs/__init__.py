"""Jobs with a command line: each is a function of a session, paths and a config."""
