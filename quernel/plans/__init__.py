"""Physical-plan helpers: lineage cuts, size-checked broadcasts, published generations."""
