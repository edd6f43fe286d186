"""Tables on storage: commits, segments, statistics and scans."""
