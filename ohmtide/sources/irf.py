"""Instrument containers: a ZIP with SQLite databases, of which any table with the required columns holds spectra, and JSON documents
on the procedure that was run.

`read` gives the rows of the tables, `spectra` cuts them into sweeps, `events` and `procedures` are what else a container says, and
`schedules` holds the programmed frequencies against the measured ones.
"""

from __future__ import annotations

import io
import json
import math
import sqlite3
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ohmtide.operators.sequence import sweep_runs

# --- fixed values: the container's names -----------------------------------------------------------------------------------
REQUIRED = ("VerifiedAppliedFrequency", "ImpedanceReal", "ImpedanceImaginary")
EVENTS = "SafetyStateEntries"
STATES = ("State", "SubState", "Version")
PARAMETERS, PARAMETER = "HeaderParameters", ("Label", "Value", "ShownUnit", "UnitSuffix")
PROGRAM = "FrequencyDistribution"
#: A program is kept to where no frequency is off by more than this share.
KEPT_TO = 0.01
# ---------------------------------------------------------------------------------------------------------------------------
POINTS = "path string, source_uid string, spectrum_id string, i int, acquisition_index double, frequency_hz double, zreal double, neg_zimag double, reason string, events int, error string"
EVENT_ROWS = "path string, source_uid string, member string, i int, event string, error string"
PROCEDURES = "path string, source_uid string, place int, member string, state string, substate string, version string, header_parameters string, programmed array<double>, error string"


def _finite(x) -> float | None:
    try:
        x = float(x)
    except (TypeError, ValueError):
        return None
    return x if math.isfinite(x) else None


def tables(raw: bytes) -> Iterator[dict]:
    """The rows of each spectrum of a container, kept or with the reason why not; rows come in the order of Index, else as stored."""
    with zipfile.ZipFile(io.BytesIO(raw)) as archive:
        for member in sorted(n for n in archive.namelist() if n.lower().endswith(".db")):
            con = sqlite3.connect(":memory:")
            con.deserialize(archive.read(member))
            names = [r[0] for r in con.execute("SELECT name FROM sqlite_master WHERE type = 'table' ORDER BY name")]
            events = con.execute(f'SELECT count(*) FROM "{EVENTS}"').fetchone()[0] if EVENTS in names else 0
            for table in names:
                quoted = table.replace('"', '""')
                columns = {r[1] for r in con.execute(f'PRAGMA table_info("{quoted}")')}
                if not set(REQUIRED) <= columns:
                    continue
                index, valid = ('"Index"' if "Index" in columns else "rowid"), ("Valid" if "Valid" in columns else "1")
                for k, (at, f, re, im, ok) in enumerate(con.execute(f'SELECT {index}, {", ".join(REQUIRED)}, {valid} FROM "{quoted}" ORDER BY {index}')):
                    f, re, im, ok = _finite(f), _finite(re), _finite(im), _finite(ok)
                    reason = "Valid=0" if ok is not None and ok <= 0 else "nonnumeric_or_nonfinite" if None in (f, re, im) else "nonpositive_frequency" if f <= 0 else None
                    yield {"spectrum_id": f"{member}:{table}", "i": k, "acquisition_index": _finite(at), "frequency_hz": f, "zreal": re, "neg_zimag": None if im is None else -im, "reason": reason, "events": events, "error": None}
            con.close()


def event_rows(raw: bytes) -> Iterator[dict]:
    """The safety events of each database in the order they are stored, as JSON objects."""
    with zipfile.ZipFile(io.BytesIO(raw)) as archive:
        for member in sorted(n for n in archive.namelist() if n.lower().endswith(".db")):
            con = sqlite3.connect(":memory:")
            con.deserialize(archive.read(member))
            if con.execute("SELECT 1 FROM sqlite_master WHERE type = 'table' AND name = ?", (EVENTS,)).fetchone():
                found = con.execute(f'SELECT * FROM "{EVENTS}" ORDER BY rowid')
                names = [c[0] for c in found.description]
                for k, row in enumerate(found):
                    yield {"member": member, "i": k, "event": json.dumps(dict(zip(names, row)), default=repr), "error": None}
            con.close()


def _objects(document) -> Iterator[dict]:
    """All JSON objects of a document, outer ones first, without recursion: documents may be nested deeply."""
    todo = [document]
    while todo:
        x = todo.pop()
        if isinstance(x, dict):
            yield x
        inner = x.values() if isinstance(x, dict) else x if isinstance(x, list) else ()
        todo.extend(reversed([v for v in inner if isinstance(v, (dict, list))]))


def procedure_rows(raw: bytes) -> Iterator[dict]:
    """What each JSON document says first of the states, the header's parameters and the programmed frequencies; one that is no JSON
    has an error."""
    with zipfile.ZipFile(io.BytesIO(raw)) as archive:
        for place, member in enumerate(archive.namelist()):
            if not member.lower().endswith(".json"):
                continue
            out = dict.fromkeys(("state", "substate", "version", "header_parameters", "programmed", "error")) | {"place": place, "member": member}
            try:
                objects = list(_objects(json.loads(archive.read(member).decode("utf-8", "replace"))))
            except ValueError:
                yield out | {"error": "no-json"}
                continue
            for name in STATES:
                said = next((x[name] for x in objects if name in x), None)
                out[name.lower()] = said if said is None or isinstance(said, str) else json.dumps(said)
            parameters = next((x[PARAMETERS] for x in objects if isinstance(x.get(PARAMETERS), list) and x[PARAMETERS]), [])
            out["header_parameters"] = json.dumps([{k: x.get(k) for k in PARAMETER} for x in parameters if isinstance(x, dict)])
            programs = ([_finite(x[0] if isinstance(x, list) and x else x) for x in o[PROGRAM]] for o in objects if isinstance(o.get(PROGRAM), list))
            out["programmed"] = next((own for p in programs if (own := [x for x in p if x is not None])), None)
            yield out


def _each(files: DataFrame, rows: Callable[[bytes], Iterator[dict]], schema: str, empty: str | None) -> DataFrame:
    """`rows` of every container. One that can't be read is one row with its error, and so is one without rows if `empty` names one."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                key = dict.fromkeys(names) | {"path": row.path, "source_uid": row.source_uid}
                try:
                    out = [key | r for r in rows(bytes(row.content))] or ([key | {"error": empty}] if empty else [])
                except Exception as e:  # noqa: BLE001  any fault of a file is its result
                    out = [key | {"error": f"{type(e).__name__}: {e}"}]
                yield pd.DataFrame(out, columns=names, dtype=object)

    return files.select("path", "source_uid", "content").mapInPandas(run, schema)


def read(files: DataFrame) -> DataFrame:
    """POINTS for files (path, source_uid, content); a container that can't be read is one row with its error."""
    return _each(files, tables, POINTS, "no-impedance-table")


def events(files: DataFrame) -> DataFrame:
    """EVENT_ROWS: a row for each safety event."""
    return _each(files, event_rows, EVENT_ROWS, None)


def procedures(files: DataFrame) -> DataFrame:
    """PROCEDURES: a row for each JSON document; `place` is where it stands in its container."""
    return _each(files, procedure_rows, PROCEDURES, None)


def spectra(points: DataFrame) -> DataFrame:
    """The kept rows of `read`, cut into sweeps: spectrum_id names the run too, and point counts from 0 inside it."""
    table = points.where("reason IS NULL AND error IS NULL").withColumn("_table", F.struct("source_uid", "path", "spectrum_id"))
    runs = sweep_runs(table, "_table", "i", "frequency_hz").drop("_table")
    runs = runs.withColumn("spectrum_id", F.concat("spectrum_id", F.lit(":run"), F.col("run").cast("string")))
    return runs.withColumn("point", F.row_number().over(Window.partitionBy("source_uid", "path", "spectrum_id").orderBy("i")) - 1)


def schedules(points: DataFrame, procedures: DataFrame) -> DataFrame:
    """(path, spectrum_id, programmed_points, measured_points, max_relative_difference, kept_to) for each table of a container with a
    program, which is that of its first document that has one. The difference is null where the numbers of points differ.

    Frequencies of a table and of a program are some thousands at most: they meet as arrays, in one join on the path."""
    program = procedures.where("programmed IS NOT NULL").groupBy("path").agg(F.min_by("programmed", "place").alias("programmed"))
    kept = points.where("reason IS NULL AND error IS NULL").groupBy("path", "spectrum_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "frequency_hz"))), lambda x: x["frequency_hz"]).alias("measured"))
    off = F.zip_with("measured", "programmed", lambda f, p: F.abs(f - p) / F.greatest(F.abs(p), F.lit(1e-30)))
    alike = F.size("measured") == F.size("programmed")
    out = kept.join(program, "path").withColumn("max_relative_difference", F.when(alike, F.array_max(off)))
    return out.select("path", "spectrum_id", F.size("programmed").alias("programmed_points"), F.size("measured").alias("measured_points"), "max_relative_difference", F.coalesce(F.col("max_relative_difference") <= KEPT_TO, F.lit(False)).alias("kept_to"))
