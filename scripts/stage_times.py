"""Slowest stages of a Spark event log (as written by ``BENCH_EVENT_LOG=1 python bench.py``).

    python scripts/stage_times.py /tmp/skycat-bench-XXXX/events/eventlog_v2_local-... [top]

Reads plain or zstd-compressed rolling event-log files; prints the total stage
time and the ``top`` slowest stages (duration, id, tasks, call site).
"""

from __future__ import annotations

import glob
import io
import json
import os
import sys


def events(path: str):
    files = sorted(glob.glob(os.path.join(path, "events_*"))) if os.path.isdir(path) else [path]
    for f in files:
        raw = open(f, "rb").read()
        if f.endswith(".zstd"):
            import zstandard

            raw = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw)).read()
        for line in raw.decode("utf-8").splitlines():
            yield json.loads(line)


def main() -> None:
    path = sys.argv[1]
    top = int(sys.argv[2]) if len(sys.argv) > 2 else 20
    stages = []
    for e in events(path):
        if e.get("Event") == "SparkListenerStageCompleted":
            si = e["Stage Info"]
            dur = (si.get("Completion Time", 0) - si.get("Submission Time", 0)) / 1000
            stages.append((dur, si["Stage ID"], si["Number of Tasks"], si["Stage Name"][:90]))
    stages.sort(reverse=True)
    print(f"{len(stages)} stages, {sum(s[0] for s in stages):.1f} stage-seconds")
    for dur, sid, tasks, name in stages[:top]:
        print(f"{dur:8.2f}s  stage {sid:<5} tasks {tasks:<5} {name}")


if __name__ == "__main__":
    main()
