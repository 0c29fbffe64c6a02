"""tonemill: text sentiment classification written as Spark jobs.

The public surface is small: read labelled text, turn it into features, train a
model table, combine models, score new text, evaluate.  Everything is a
DataFrame in and a DataFrame out.
"""

from tonemill.operators.ensemble import best_of, ensemble
from tonemill.operators.evaluate import confusion, evaluate
from tonemill.operators.vectors import sentiment_vectors
from tonemill.plans.training import (
    FeatureOptions,
    build,
    build_requests,
    classify,
    classify_combined,
    classify_requests,
    increment,
    load_model,
    rebuild,
    train,
    train_shards,
)
from tonemill.sources.corpus import read_class_dirs, read_labelled_lines
from tonemill.sources.lexicon import read_lexicon, score_lexicon
from tonemill.sources.registry import latest_model, load_models, save_models

__all__ = [
    "FeatureOptions",
    "best_of",
    "build",
    "build_requests",
    "classify",
    "classify_combined",
    "classify_requests",
    "confusion",
    "ensemble",
    "evaluate",
    "increment",
    "latest_model",
    "load_model",
    "load_models",
    "read_class_dirs",
    "read_labelled_lines",
    "read_lexicon",
    "rebuild",
    "save_models",
    "score_lexicon",
    "sentiment_vectors",
    "train",
    "train_shards",
]
