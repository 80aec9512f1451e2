"""Inversions of spectra on the cluster: pure array functions, one call a spectrum, in Arrow batches.

Spectra come as rows (uid, points), some KB each. A solution takes far longer than moving its spectrum, so rows are dealt evenly to
all cores first, and all that is asked of one spectrum is asked in one call: solutions at several lambdas share its kernel. A spectrum that can't be solved is a row of status `failed` with
the error, never a failed job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATUS = "status string, error string"


def per_spectrum(spectra: DataFrame, solve: Callable[..., list[dict]], schema: str, *carry: str, uid: str = "bigint") -> DataFrame:
    """uid, carried columns, the rows of solve(frequency_hz, z, carried values ...), and status and error."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                key = {"uid": row.uid} | {c: getattr(row, c) for c in carry}
                try:
                    f = np.array([p["frequency_hz"] for p in row.points], float)
                    z = np.array([p["zreal"] - 1j * p["neg_zimag"] for p in row.points], complex)
                    found = solve(f, z, *(key[c] for c in carry))
                    out += [key | r | {"status": "completed", "error": None} for r in found]
                except Exception as e:  # noqa: BLE001  any fault of a spectrum is its result
                    out.append(key | dict.fromkeys(names) | {"status": "failed", "error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame(out, columns=["uid", *carry, *names, "status", "error"], dtype=object)

    types = dict(spectra.dtypes)
    whole = ", ".join([f"uid {uid}", *(f"{c} {types[c]}" for c in carry), schema, STATUS])
    dealt = spectra.select("uid", "points", *carry)
    # Each core has a task of its own; linear algebra that starts threads besides would only make them wait for each other.
    for name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS"):
        dealt.sparkSession.sparkContext.environment.setdefault(name, "1")
    tasks = max(dealt.sparkSession.sparkContext.defaultParallelism, int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # By a hash of its own: by uid alone, an aggregation by uid before would pass for the dealing, and may be one task.
    return dealt.repartition(tasks, F.xxhash64("uid", F.lit("dealt"))).mapInPandas(run, whole)
