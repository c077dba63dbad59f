"""Time the headline queries; prints one JSON line.

Each query is written to Spark's ``noop`` sink, so every column of every row is computed
and nothing is collected. A query is run once to warm up and then timed.
"""

from __future__ import annotations

import json
import os
import time
from pathlib import Path

from papyra.plans import load_all
from papyra.session import local_session

HEADLINES = [
    "c1_filter_bad_rows", "c5_exact_doc_dedup", "c6_paragraph_dedup", "c7_curate_doc_level", "c8_curate_crawl",
    "c13_link_extraction", "c14_html_to_text",
    "d3_sentence_split", "d5_longest_match", "d11_word_shape", "d14_strip_diacritics", "d16_vowel_sequence",
    "e4_vocabulary_counts", "e6_tfidf", "e9_tagging_context", "e13_index_sequence", "e27_sliding_id_windows",
    "f12_transition_samples", "g3_auc", "g4_entity_scores", "h3_act_history",
    "i1_lead_features", "i2_rolling_samples", "i7_extreme_flag",
    "j1_inverted_index", "j2_and_search", "k1_hourly_status", "k2_top_urls",
]


def sentences_per_second(spark, sf_dir: str, seconds: float) -> float:
    from papyra.plans.textual import _sentences

    return _sentences(spark, sf_dir).count() / seconds


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cores, "bench")
    known, times = load_all(), {}
    for name in HEADLINES:
        for _ in range(2):
            start = time.perf_counter()
            known[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
    report = {
        "metric": "total_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": Path(sf_dir).name.removeprefix("sf"),
        "cpus": cores,
        "segmentation_sentences_per_sec": round(sentences_per_second(spark, sf_dir, times["d5_longest_match"])),
    }
    spark.stop()
    print(json.dumps(report))


if __name__ == "__main__":
    main()
