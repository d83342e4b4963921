"""Reading, merging and writing record tables: batch outputs, replies, manifests, shards."""
