"""DataFrame operators: merging, tiers, buckets, labels, display, deduplication, anchors, consensus, stores."""
