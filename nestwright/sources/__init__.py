"""Sources of batches."""

from nestwright.sources.batches import batch_source, dfs_to_lazy_df

__all__ = ["batch_source", "dfs_to_lazy_df"]
