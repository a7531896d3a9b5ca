"""Where points come from and go to: the mutation log, snapshots, table adapters."""
