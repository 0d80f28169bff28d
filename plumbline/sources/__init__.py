"""Where documents come from and go to: line-delimited JSON, snapshots, postings files, routed subsets."""
