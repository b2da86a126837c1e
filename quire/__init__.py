"""quire: Spark-native planning of batched question prompts.

DataFrame in, DataFrame out: similarity joins, clustering, greedy set cover,
assignment, bin packing, prompt rendering and answer scoring.
"""

from quire.config import PlanConfig
from quire.session import cut_lineage, ensure_checkpoint_dir, get_spark, prepare

__all__ = ["PlanConfig", "cut_lineage", "ensure_checkpoint_dir", "get_spark", "prepare"]
