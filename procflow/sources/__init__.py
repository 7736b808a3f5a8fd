"""Readers, the star-schema builder, staging in the shared folder, and report sinks."""
