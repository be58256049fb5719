"""Plans built from the operators.

``prepare`` - packaged files, their reads, mounts with families;
``waits`` - the wait and host-tape jobs (and their one-shuffle combinations);
``ingest`` - incremental copy in date slices with resume;
``jobs`` - file/JDBC-to-file job entry points and the command line;
``suite`` - the registered check queries over the driver's tables.
"""
