"""Features from user-supplied encoders and readers: batched, on distinct inputs, checked, stamped."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetrace.plans.shared import shipped
from kinetrace.sources.archives import located

Encoder = Callable[[list], np.ndarray]


def extract_features(frames: DataFrame, keys: list[str], payload: str, make_encoder: Callable[[], Encoder], extractor: str, batch: int = 256) -> DataFrame:
    """keys, features (flat, row-major), shape, extractor_id of distinct frames. The encoder is made once a task; a changed shape or a non-finite number stops the job."""
    wanted = frames.dropDuplicates(keys).select(*keys, payload)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, shape = make_encoder(), None
        for rows in batches:
            for at in range(0, len(rows), batch):
                part = rows.iloc[at : at + batch]
                out = np.asarray(encoder(part[payload].tolist()), float)
                shape = shape or out.shape[1:]
                if out.shape[1:] != shape or len(out) != len(part) or not np.isfinite(out).all():
                    raise ValueError(f"encoder gave shape {out.shape} after {shape}, or numbers that aren't finite")
                yield part[keys].assign(features=list(out.reshape(len(out), -1)), shape=[list(shape)] * len(out), extractor_id=extractor)

    kinds = ", ".join(f"`{k}` {frames.schema[k].dataType.simpleString()}" for k in keys)
    return shipped(wanted).mapInPandas(encode, f"{kinds}, features array<double>, shape array<int>, extractor_id string")


def extract_text_features(prompts: DataFrame, text: str, make_encoder: Callable[[], Encoder], extractor: str) -> DataFrame:
    """Each distinct prompt is encoded once, and its vector normalised."""
    out = extract_features(prompts.select(text).distinct().withColumn("_p", F.col(text)), [text], "_p", make_encoder, extractor)
    norm = F.sqrt(F.aggregate("features", F.lit(0.0), lambda s, x: s + x * x))
    return out.withColumn("features", F.transform("features", lambda x: x / norm)).drop("shape")


def fingerprint(path: str, sample: int = 1 << 20) -> tuple[int, int, str]:
    """Size, time of change and SHA-256 of the size and the first and last `sample` bytes of a file."""
    system, at = located(path)
    info = system.get_file_info(at)
    if not info.is_file:
        raise FileNotFoundError(path)
    with system.open_input_file(at) as file:
        head = file.read_at(min(sample, info.size), 0)
        tail = file.read_at(min(sample, info.size), max(0, info.size - sample))
    return info.size, info.mtime_ns or 0, hashlib.sha256(str(info.size).encode() + head + tail).hexdigest()


def unchanged(fn: Callable[[dict], dict], path: str, stamp: bool = False, sample: int = 1 << 20) -> Callable[[dict], dict]:
    """A row plug-in that fails if the file named in column `path` isn't the same before and after fn. stamp: adds the file's digest to what fn gives."""

    def guarded(row: dict) -> dict:
        before = fingerprint(row[path], sample)
        out = fn(row)
        if fingerprint(row[path], sample) != before:
            raise ValueError("the source changed while it was read")
        return out | {"fingerprint": before[2]} if stamp else out

    return guarded


def build_timelines(readers: list[Callable[[dict], tuple[list[float], str]]], tick: float) -> Callable[[dict], dict]:
    """A row plug-in for `quarantine`: tries the readers in turn, checks the count against declared_frames, sorts, and repairs repeated times by ticks."""

    def read(row: dict) -> dict:
        error: Exception | None = None
        for reader in readers:
            try:
                times, method = reader(row)
                break
            except Exception as e:  # the next reader is the answer to any failure of this one
                error = e
        else:
            raise error or ValueError("no reader")
        declared = row.get("declared_frames")
        if declared is not None and len(times) != declared:
            raise ValueError(f"{len(times)} times for {int(declared)} frames")
        times = sorted(float(t) for t in times)
        if len(times) < 2 or not np.isfinite(times).all():
            raise ValueError("a timeline needs two finite times")
        distinct = sorted(set(times))
        following = dict(zip(distinct, [*distinct[1:], float("inf")], strict=True))
        out: list[float] = []
        nth = 0
        for i, t in enumerate(times):
            nth = nth + 1 if i and times[i - 1] == t else 0
            fixed = t + nth * tick
            if nth and fixed >= following[t]:
                raise ValueError("repair reaches the next time")
            out.append(fixed)
        return {"pts": out, "method": method}

    return read
