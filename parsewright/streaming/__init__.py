"""No operator here works on streams: corpora are files that are read to their end."""
