"""BERTScore through its own library, where that and a model are installed; the kernel alone is metrics.greedy_match."""

from __future__ import annotations

import importlib.util
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnengine.schema import EngineError

#: Default model and pairs per batch (fixed values).
MODEL, BATCH = "bert-base-multilingual-cased", 64
NEEDS = ("torch", "bert_score")


def require() -> None:
    """Raise early, on the driver, if a library is missing."""
    if lost := [n for n in NEEDS if importlib.util.find_spec(n) is None]:
        raise EngineError(f"BERTScore needs {', '.join(lost)}; score without it instead")


def add_bertscore(pairs: DataFrame, model: str = MODEL, batch: int = BATCH) -> DataFrame:
    """pairs with bertscore: F1 x 100 without rescaling, 0 where either side is empty; one model per worker task."""
    require()
    names = pairs.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import bert_score
        import torch

        scorer = bert_score.BERTScorer(model_type=model, batch_size=batch, device="cuda" if torch.cuda.is_available() else "cpu")
        for frame in frames:
            both = (frame["gemma"] != "") & (frame["golden"] != "")
            frame = frame.assign(bertscore=0.0)
            if both.any():
                frame.loc[both, "bertscore"] = (scorer.score(frame["gemma"][both].tolist(), frame["golden"][both].tolist())[2] * 100).numpy()
            yield frame[[*names, "bertscore"]]

    return pairs.mapInPandas(run, T.StructType([*pairs.schema.fields, T.StructField("bertscore", T.DoubleType())]))


def bert_text(score: Column, used: bool) -> Column:
    """The score as a fraction to four places, or n/d where BERTScore was not asked for."""
    return F.format_string("%.4f", score / 100) if used else F.lit("n/d")
