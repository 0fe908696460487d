"""Wall time of the headline queries; prints one JSON line.

``BENCH_SF_DIR`` (default ``/root/testdata/sf0.1``) names the tables, ``BENCH_CPUS`` the cores.
Every result is computed whole and written to the ``noop`` sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from capframe.catalogue.queries import QUERIES
from capframe.session import get_spark

HEADLINE = """
tokens all_tokens word_freq vocab encoded_captions label_encoded split_exact shuffled_order batches
prepared_photos metrics_observed metrics_by_config config_compare caption_stats top_words_by_label prompts
rendered_prompts parse_label padded_batch complete_captions prompted_classification modality_pairs mean_pool
infonce centroid_argmax vector_lookup epoch_loss early_stop image_tensors text_classifier
""".split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    names = sys.argv[1:] or HEADLINE
    spark = get_spark(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "8g"),
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["tokens"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start the engine
    times = {}
    for name in names:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    spark.stop()
    line = {
        "metric": "total wall time of headline queries",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
