"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is built and run to completion with the ``noop`` sink (every row
is computed, nothing is collected): one warm-up, then the median of
``$BENCH_RUNS`` runs (default 3). Time includes building the plan, since the
selection survey job is part of the query. Prints one JSON line.
"""

from __future__ import annotations

import glob
import io
import json
import os
import statistics
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from pyspark.sql import functions as F  # noqa: E402

from provlens.functions.normalise import sql_ident  # noqa: E402
from provlens.operators import affiliations as A  # noqa: E402
from provlens.operators import engagement as E  # noqa: E402
from provlens.operators import registry as R  # noqa: E402
from provlens.plans import profile as PR  # noqa: E402
from provlens.plans.queries import QUERIES  # noqa: E402
from provlens.sources.files import csv_roundtrip  # noqa: E402
from provlens.sources.selections import Selections  # noqa: E402
from provlens.sources.tables import Inputs  # noqa: E402
from provlens.session import build_session  # noqa: E402

HEADLINE = (
    "profile_wide", "profile_wide_left", "profile_part_d_only", "engagement_outer",
    "claims_wide", "payments_wide", "registry_filtered", "affiliations_top4",
    "activity_filter", "ranked_view", "drug_category_totals", "wide_to_long",
    "catalog_procedures", "run_history", "null_report", "table_shape",
)


def run_once(spark, key: str, sf_dir: str) -> tuple[float, int, str]:
    sc = spark.sparkContext
    group = f"bench-{key}-{time.time_ns()}"
    sc.setJobGroup(group, key)
    t0 = time.perf_counter()
    QUERIES[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
    dt = time.perf_counter() - t0
    jobs = len(sc.statusTracker().getJobIdsForGroup(group))
    sc.setLocalProperty("spark.jobGroup.id", None)
    return dt, jobs, group


def shuffle_bytes_by_group(log_dir: str) -> dict[str, int]:
    """Shuffle bytes written per job group, read from Spark's event log."""
    stage_group: dict[int, str] = {}
    written: dict[str, int] = {}
    for path in glob.glob(f"{log_dir}/**/events*", recursive=True):
        raw = open(path, "rb").read()
        if path.endswith(".zstd"):
            import zstandard
            raw = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw)).read()
        for line in raw.decode("utf-8", "replace").splitlines():
            try:
                ev = json.loads(line)
            except ValueError:
                continue
            kind = ev.get("Event")
            if kind == "SparkListenerJobStart":
                g = (ev.get("Properties") or {}).get("spark.jobGroup.id")
                for sid in ev.get("Stage IDs", []):
                    stage_group[sid] = g
            elif kind == "SparkListenerTaskEnd":
                g = stage_group.get(ev.get("Stage ID"))
                m = (ev.get("Task Metrics") or {}).get("Shuffle Write Metrics") or {}
                if g:
                    written[g] = written.get(g, 0) + int(m.get("Shuffle Bytes Written", 0))
    return written


def profile_staged(src, sel, opts=None):
    """The same result executed in the reference's shape, for measurement only:
    an action after each stage and a CSV round trip of the intermediate
    (registry x engagement) before the affiliation join.
    """
    opts = opts or PR.ProfileOptions()
    measures = PR.measures_for(sel, opts)
    long = PR.engagement_for(src, sel, opts)
    long.count()
    wide = E.pivot_wide(long, measures, total=PR.TOTAL)
    wide.count()
    reg = R.registry_filtered(src.providers, src.taxonomy, sel)
    reg.count()
    phase1 = csv_roundtrip(reg.join(wide, "npi", "inner"), "phase-1")
    phase1.count()
    aff = A.affiliations_top(A.affiliations_clean(src.affiliations), opts.top_k)
    cols = R.provider_block(phase1) + list(A.affiliation_block(opts.top_k)) + \
        [F.col(sql_ident(m.name)) for m in measures]
    return phase1.join(aff, "npi", opts.affiliation_join).where(F.col(PR.TOTAL) > 0).select(*cols)


def staged_once(spark, sf_dir: str) -> float:
    """The flagship in the reference's execution shape (actions per stage,
    CSV round trip in the middle), for comparison with ``profile_wide``."""
    t0 = time.perf_counter()
    i = Inputs(spark, sf_dir)
    profile_staged(i, Selections.from_inputs(i)).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    wanted = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE))
    keys = sorted(QUERIES) if wanted == "all" else [k for k in wanted.split(",") if k]
    # one shuffle partition per core at bench scale; AQE coalesces further
    log_dir = tempfile.mkdtemp(prefix="provlens-bench-events-")
    os.environ.setdefault("PROVLENS_EVENT_LOG_DIR", log_dir)
    spark = build_session(f"local[{cpus}]", shuffle_partitions=cpus, app_name="provlens-bench")
    errors: dict[str, str] = {}
    for key in keys:  # warm-up pass over every query first (JIT, file caches)
        try:
            run_once(spark, key, sf_dir)
        except Exception as exc:  # a failing query is reported, not fatal
            errors[key] = str(exc).splitlines()[0][:200]
    keys = [k for k in keys if k not in errors]
    samples: dict[str, list[tuple[float, int, str]]] = {k: [] for k in keys}
    for _ in range(runs):  # round-robin, so no query is measured cold
        for key in keys:
            samples[key].append(run_once(spark, key, sf_dir))
    per_query = {k: round(statistics.median(s[0] for s in v), 3) for k, v in samples.items()}
    jobs = {k: v[-1][1] for k, v in samples.items()}
    staged = None
    if os.environ.get("BENCH_STAGED", "1") == "1" and "profile_wide" in keys:
        staged_once(spark, sf_dir)
        staged = round(statistics.median(staged_once(spark, sf_dir) for _ in range(runs)), 3)
    sf = os.path.basename(sf_dir).replace("sf", "")
    spark.stop()  # flushes the event log
    by_group = shuffle_bytes_by_group(os.environ["PROVLENS_EVENT_LOG_DIR"])
    shuffle = {k: by_group.get(v[-1][2], 0) for k, v in samples.items()}
    print(json.dumps({
        "metric": "sum_of_median_query_seconds",
        "value": round(sum(per_query.values()), 3),
        "unit": "sec",
        "queries": per_query,
        "jobs": jobs,
        "shuffle_bytes": shuffle,
        "profile_wide_reference_shape_sec": staged,
        "errors": errors,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "cpus": cpus,
        "runs": runs,
    }))


if __name__ == "__main__":
    main()
