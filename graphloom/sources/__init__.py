"""Sources and sinks: generators, binary CSR files, profiles and schedules as text."""
