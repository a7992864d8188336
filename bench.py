"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from palaver.plans.catalogue import QUERIES  # noqa: E402
from palaver.session import local_session  # noqa: E402
from palaver.sources.tables import chat_messages  # noqa: E402

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
# query -> table whose rows are the messages of that query
HEADLINE = {
    "participants": "events", "room_summary": "events", "time_profile": "events", "gap_quantiles": "events",
    "session_stats": "events", "reply_edges": "events", "monologue": "events", "reference_bands": "events",
    "bursts_heuristic": "orders", "chapters": "orders", "msg_flags": "events", "room_events": "events",
    "lexicon_sentiment": "events", "emoji_counts": "events", "profanity": "events", "tokens": "documents",
    "term_stats": "documents", "keyword_candidates": "documents", "keywords_korean": "events",
    "cooccurrence": "documents", "repeated_phrases": "documents", "cluster_coherence": "embeddings",
    "timeline": "events", "stream_switches": "events",
}


def analysis(spark, factor: int) -> dict:
    """One whole ``analyze`` over the chat messages, repeated ``factor`` times as rooms of their own."""
    from pyspark.sql import functions as F

    from palaver import analyze

    cols = ["room_id", "line", "ts", "sender", "message"]
    rooms = F.explode(F.sequence(F.lit(1), F.lit(factor))).alias("copy")
    messages = chat_messages(spark, FOLDER).select(*cols, rooms).withColumn("room_id", F.concat_ws("-", "room_id", "copy")).select(*cols)
    rows = messages.count()
    start = time.time()
    for table in analyze(messages).values():
        table.write.format("noop").mode("overwrite").save()
    seconds = round(time.time() - start, 3)
    return {"messages": rows, "sec": seconds, "messages_per_sec": round(rows / seconds)}


def main() -> None:
    spark = local_session(CPUS, shuffle_partitions=int(CPUS), memory=os.environ.get("BENCH_MEMORY", "16g"))
    spark.sparkContext.setLogLevel("OFF")
    sizes = {t: spark.read.parquet(f"{FOLDER}/{t}.parquet").count() for t in set(HEADLINE.values())}
    QUERIES["daily"](spark, FOLDER).write.format("noop").mode("overwrite").save()  # warm the JVM
    times, rates = {}, {}
    for name, table in HEADLINE.items():
        start = time.time()
        QUERIES[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        rates[name] = round(sizes[table] / times[name])
    whole = {}
    for factor in (1, 10) if os.environ.get("BENCH_ANALYZE") == "10" else (1,):
        whole[f"analyze_x{factor}"] = analysis(spark, factor)
    print(json.dumps({
        "metric": "sum of headline query times", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "rows_per_sec": rates, "analysis": whole, "sf": Path(FOLDER).name,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
