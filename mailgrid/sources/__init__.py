"""Tables, delimited files, dated snapshots, landed service pages and file manifests."""
