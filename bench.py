"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import threading
import time

from jobweave import checks, session

# Heavy and typical work of every area; decode_compact and
# search_literal are the counterparts of the two published soft limits
HEADLINE = [
    "dedupe_by_id", "merge_catalog", "dedupe_any_key", "dedupe_best_quality", "upsert_replace", "rank_domestic", "classify",
    "section_profile", "keywords", "extract_links", "stage_transitions", "stream_source_health", "decode_compact", "search_literal", "recommend",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = os.environ.get("BENCH_QUERIES")
    names = only.split(",") if only else HEADLINE
    spark = session.local_session(cpus, shuffle_partitions=max(8, 2 * int(cpus) if cpus.isdigit() else 16), memory="20g")
    registered = checks.load().queries
    spark.range(1000).count()
    # a run that takes far too long still reports: its last query is cancelled and told as unfinished
    limit = threading.Timer(float(os.environ.get("BENCH_LIMIT", "900")), spark.sparkContext.cancelAllJobs)
    limit.daemon = True
    limit.start()
    times, unfinished = {}, []
    for name in names:
        start = time.perf_counter()
        try:
            registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        except Exception:
            if limit.is_alive():
                raise
            unfinished.append(name)
        times[name] = round(time.perf_counter() - start, 3)
        spark.catalog.clearCache()
        if not limit.is_alive():
            unfinished += [n for n in names if n not in times and n not in unfinished]
            break
    limit.cancel()
    spark.stop()
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir).removeprefix("sf")} | ({"unfinished": unfinished} if unfinished else {})))


if __name__ == "__main__":
    main()
