"""A scoring run over a grid of shards, which takes up where it stopped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import panel, scores
from ..sources import shards


def score_shards(items: DataFrame, path: str, make: Callable[[], scores.Scorer], mode: str = "letter", **kw) -> tuple[int, int]:
    """Scores the shards of ``items`` (benchmark, model, language, item_id, prompt, options, answer_index) that aren't done under ``path``, and writes them; returns how many shards and rows.

    The scorer gets all of these columns and returns (shard key, item_id, predicted, answer_index). A shard that a run left without its marker is scored anew; whole ones are left as they are.
    """
    wanted = items.withColumn("mode", F.lit(mode))
    left = panel.outstanding(wanted, shards.done(items.sparkSession, path), *shards.KEY)
    schema = ", ".join([*(f"{k} string" for k in shards.KEY), "item_id string, predicted smallint, answer_index int"])
    found = scores.scored(left, make, schema, mode, **kw)
    correct = F.coalesce(F.col("predicted") == F.col("answer_index"), F.lit(False)).cast("tinyint")
    return shards.write(found.select(*shards.KEY, "item_id", "predicted", correct.alias("correct")), path)
