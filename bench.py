"""Run the headline queries and print one JSON line with the seconds of each."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tonemill.plans import catalogue
from tonemill.session import local_session

HEADLINE = [
    "a3_sentiment_vectors",
    "a7_gaussian_fit",
    "w4_classify",
    "a14_confusion",
    "a15_evaluation",
    "a16_cross_validation",
    "a12_voting",
    "x1_learner_by_name",
    "a4_lemma_frequency",
    "a5_presence_vectors",
    "a6_information_gain",
    "a8_multinomial_fit",
    "a8_multinomial_classify",
    "f6_shingles",
    "f7_char_ngrams",
    "a1_lexicon_build",
    "j4_nearest_neighbours",
    "j5_local_bayes",
    "w1_chunks",
    "t1_stream_word_training",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    # The first jobs pay for starting the engine and compiling its code; an untimed run of
    # one query on the smallest tables, where they are at hand, takes that out of the times.
    spark.range(1000).selectExpr("sum(id)").collect()
    smallest = Path(sf_dir).parent / "sf0.001"
    if smallest.is_dir():
        catalogue.QUERIES["w4_classify"](spark, str(smallest)).collect()
    seconds: dict[str, float] = {}
    for name in names:
        started = time.perf_counter()
        catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
