"""The event log as a stream: appended files fold into tables with exactly-once sinks."""
