"""Embedding models over series: tensors from subsamples, an injected session, pooled vectors.

A session is anything with ``run(output_names, inputs) -> list of arrays``; ``session_from`` makes one
from a local model file, once per worker and with one thread. Weights are not part of this library.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .reductions import subsamples


@lru_cache(maxsize=4)
def session_from(path: str):
    import onnxruntime

    options = onnxruntime.SessionOptions()
    options.intra_op_num_threads = options.inter_op_num_threads = 1  # a task has one core
    return onnxruntime.InferenceSession(path, options, providers=["CPUExecutionProvider"])


def _place(values: np.ndarray, size: int, left: bool = False, fill: float = 0.0) -> np.ndarray:
    out = np.full(size, fill, np.float32)
    if len(values):
        out[(size - len(values) if left else 0) :][: len(values)] = values
    return out


@dataclass(frozen=True)
class EmbeddingModel:
    """``tensors(t, m, sigma, band) -> dict`` for one subsample; ``seq`` observations at most."""

    name: str
    seq: int
    dim: int
    tensors: Callable[..., dict[str, np.ndarray]]
    outputs: tuple[str, ...] = ("mean",)
    multiband: bool = False
    lengths: tuple[tuple[str, int], ...] = ()  # of bands that are reduced each by itself
    reduction: str = "non-overlapping-windows"


def flux_scale(flux: np.ndarray, mag_zp: float, model_zp: float = 27.5) -> np.ndarray:
    return np.asarray(flux, float) * 10 ** (-0.4 * (mag_zp - model_zp))


def astromer(t, m, sigma, band, size=200):
    """Zero-mean time and value over what is there."""
    return {"times": _place(t - t.mean(), size)[None, :, None], "input": _place(m - m.mean(), size)[None, :, None], "mask_in": _place(np.ones(len(t)), size)[None, :, None]}


def _band_number(band, order):
    at = {b: k for k, b in enumerate(order)}
    if unknown := sorted({str(b) for b in band if b not in at}):
        raise ValueError(f"the model has no band {', '.join(unknown)}; there are {', '.join(order)}")
    return np.array([at[b] for b in band], np.int64)


def atcat(t, m, sigma, band, size=243, mag_zp=31.4, order=("u", "g", "r", "i", "z", "Y")):
    """Times from the first, fluxes at the model's zero point, band numbers."""
    return {
        "flux": _place(flux_scale(m, mag_zp), size)[None], "flux_err": _place(flux_scale(sigma, mag_zp), size)[None], "time": _place(t - t[0] if len(t) else t, size)[None],
        "mask": (_place(np.ones(len(t)), size) > 0)[None], "channel_index": _place(_band_number(band, order), size)[None].astype(np.int64),
    }


def atat(t, m, sigma, band, size=65, mag_zp=31.4, order=("u", "g", "r", "i", "z", "Y")):
    """A channel per band, at most ``size`` observations each; the earliest time is 0."""
    first = float(t.min()) if len(t) else 0.0
    data, time, mask = (np.zeros((1, size, len(order)), np.float32) for _ in range(3))
    for k, b in enumerate(order):
        own = np.flatnonzero(band == b)[:size]
        data[0, : len(own), k], time[0, : len(own), k], mask[0, : len(own), k] = flux_scale(m[own], mag_zp), t[own] - first, 1
    return {"data": data, "time": time, "mask": mask}


def astra_clr(t, m, sigma, band, lengths=(("g", 300), ("r", 350), ("i", 50)), waves=(("g", 4746.48), ("r", 6366.38), ("i", 7829.03)), origin=58000.0):
    """Blocks per band of fixed length, one after another: value less its weighted mean, time, log wavelength; mask 1 marks padding."""
    wave, blocks, pads = dict(waves), [], []
    for b, size in lengths:
        own = np.flatnonzero(band == b)[:size]
        w = 1 / np.maximum(sigma[own], 1e-12) ** 2
        mean = float((w * m[own]).sum() / w.sum()) if len(own) else 0.0
        rows = np.stack([_place(m[own] - mean, size), _place(t[own] - origin, size), _place(np.full(len(own), np.log10(wave[b])), size)], 1)
        blocks.append(rows), pads.append(np.arange(size) >= len(own))
    whole = np.concatenate(blocks)[None].astype(np.float32)
    return {name: whole[:, :, [k]] for k, name in enumerate(("input", "times", "band_info"))} | {"mask": np.concatenate(pads)[None].astype(np.float32)}


def left_padded(multiple: int | None, fixed: int | None = None):
    """Values alone, NaN before them, at a fixed length or at the next multiple."""

    def tensors(t, m, sigma, band):
        size = fixed or -(-max(len(m), 1) // multiple) * multiple
        return {"context": _place(m, size, left=True, fill=np.nan)[None]}

    return tensors


MODELS = {
    "astromer1": EmbeddingModel("astromer1", 200, 256, astromer, ("mean", "max", "sequence")),
    "astromer1_ztf": EmbeddingModel("astromer1_ztf", 200, 256, astromer, ("mean", "max", "sequence")),
    "astromer2": EmbeddingModel("astromer2", 200, 256, astromer, ("mean", "max", "sequence")),
    "atcat": EmbeddingModel("atcat", 243, 384, atcat, ("last", "mean", "sequence"), True),
    "atat": EmbeddingModel("atat", 390, 192, atat, ("token", "mean", "sequence"), True, tuple((b, 65) for b in ("u", "g", "r", "i", "z", "Y"))),
    "astra_clr": EmbeddingModel("astra_clr", 700, 512, astra_clr, ("mean",), True, (("g", 300), ("r", 350), ("i", 50)), "beginning"),
    "chronos2": EmbeddingModel("chronos2", 8192, 768, left_padded(16), ("mean", "sequence")),
    "chronos_bolt_tiny": EmbeddingModel("chronos_bolt_tiny", 2048, 256, left_padded(16), ("mean", "sequence")),
    "chronos_bolt_mini": EmbeddingModel("chronos_bolt_mini", 2048, 384, left_padded(16), ("mean", "sequence")),
    "chronos_bolt_small": EmbeddingModel("chronos_bolt_small", 2048, 512, left_padded(16), ("mean", "sequence")),
    "chronos_bolt_base": EmbeddingModel("chronos_bolt_base", 2048, 768, left_padded(16), ("mean", "sequence")),
    "moment1_small": EmbeddingModel("moment1_small", 512, 512, left_padded(None, 512), ("mean", "sequence")),
    "moment1_base": EmbeddingModel("moment1_base", 512, 768, left_padded(None, 512), ("mean", "sequence")),
    "moment1_large": EmbeddingModel("moment1_large", 512, 1024, left_padded(None, 512), ("mean", "sequence")),
}


def _by_band(series: DataFrame, lengths: Sequence[tuple[str, int]], reduction: str | Sequence[str], seed: int) -> DataFrame:
    """``object_id, group, subs``: each band reduced by itself; a step holds that step of every band, which may be empty."""
    hows = [reduction] if isinstance(reduction, str) else list(reduction)
    parts = {(h, k): subsamples(F.filter("s", lambda x: x["band"] == b), size, how, F.col("object_id"), seed) for h, how in enumerate(hows) for k, (b, size) in enumerate(lengths)}
    cut = series.select("object_id", "group", F.slice("s", 1, 0).alias("none"), *[p.alias(f"p_{h}_{k}") for (h, k), p in parts.items()])

    def steps(h: int) -> Column:
        own = [F.col(f"p_{h}_{k}") for k in range(len(lengths))]
        last = F.greatest(F.lit(0), *[F.size(p) - 1 for p in own])
        return F.transform(F.sequence(F.lit(0), last), lambda w: F.concat(*[F.coalesce(F.get(p, w), F.col("none")) for p in own]))

    return cut.select("object_id", "group", F.concat(*[steps(h) for h in range(len(hows))]).alias("subs"))


#: Subsamples that go through a session at a time.
TOGETHER = 64


def infer(model, output: str, tensors: list[dict[str, np.ndarray]]) -> list[np.ndarray]:
    """(place, dimension) of each subsample; those of equal shapes go through the session together."""
    found: list = [None] * len(tensors)
    shapes: dict[tuple, list[int]] = {}
    for k, x in enumerate(tensors):
        shapes.setdefault(tuple((n, v.shape) for n, v in x.items()), []).append(k)
    for rows in shapes.values():
        for a in range(0, len(rows), TOGETHER):
            part = rows[a : a + TOGETHER]
            got = np.asarray(model.run([output], {n: np.concatenate([tensors[k][n] for k in part]) for n in tensors[part[0]]})[0])
            for k, row in zip(part, got.reshape(len(part), -1, got.shape[-1]), strict=True):
                found[k] = row
    return found


def embed(df: DataFrame, model: str | EmbeddingModel, session: Callable[[], object], *, output: str | None = None, reduction: str | Sequence[str] | None = None, bands: Sequence[str] | None = None, band_groups: Sequence[dict[str, str]] | None = None, allow_extra_bands: bool = False, seed: int = 0) -> DataFrame:
    """``object_id, band, step, embedding``: one vector per object, band (or group of bands) and subsample.

    ``session`` is called once in each worker. A single-band model takes ``bands`` one at a time (all
    observations, if none are given); a multi-band one takes each of ``band_groups``, which map the
    model's band names to labels. ``sequence`` gives a row per place, ``seq`` in a column of its own.
    ``output`` and ``reduction`` are the model's first and own by default.
    """
    spec = MODELS[model] if isinstance(model, str) else model
    output, reduction = output or spec.outputs[0], reduction or spec.reduction
    if output not in spec.outputs:
        raise ValueError(f"{spec.name} gives {', '.join(spec.outputs)}, not {output}")
    if spec.multiband and band_groups:
        known = {label for g in band_groups for label in g.values()}
        labels = F.create_map(*[F.lit(x) for k, g in enumerate(band_groups) for name, label in g.items() for x in (f"{k}:{label}", name)])
        parts = [df.where(F.col("band").isin(*g.values())).withColumn("group", F.lit(str(k))).withColumn("band", F.try_element_at(labels, F.concat(F.lit(f"{k}:"), F.col("band")))) for k, g in enumerate(band_groups)]
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
    elif bands is not None:
        known = set(bands)
        rows = df.where(F.col("band").isin(*bands)).withColumn("group", F.lit("") if spec.multiband else F.col("band"))
    else:
        known, rows = None, df.withColumn("group", F.lit(""))
    if known is not None and not allow_extra_bands and not df.where(~F.col("band").isin(*known) | F.col("band").isNull()).isEmpty():
        raise ValueError("there are bands that the model isn't given; allow_extra_bands leaves them out")
    series = rows.groupBy("object_id", "group").agg(F.array_sort(F.collect_list(F.struct("t", "m", "sigma", "band"))).alias("s"))
    subs = _by_band(series, spec.lengths, reduction, seed) if spec.lengths else series.select("object_id", "group", subsamples(F.col("s"), spec.seq, reduction, F.col("object_id"), seed).alias("subs"))
    cut = subs.select("object_id", "group", F.posexplode("subs").alias("step", "x"))
    flat = cut.select("object_id", F.col("group").alias("band"), "step", *[F.col(f"x.{c}").alias(f"x_{c}") for c in ("t", "m", "sigma", "band")])
    kind = df.schema["object_id"].dataType.simpleString()
    whole = output == "sequence"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = session()
        for batch in batches:
            found, owner, place = [], [], []
            cols = [batch.column(f"x_{c}").to_pylist() for c in ("t", "m", "sigma", "band")]
            inputs = [spec.tensors(np.asarray(t, float), np.asarray(m, float), np.asarray(sigma, float), np.asarray(band, object)) for t, m, sigma, band in zip(*cols, strict=True)]
            for k, got in enumerate(infer(model, output, inputs)):
                for j, row in enumerate(got if whole else got[:1]):
                    owner.append(k), place.append(j), found.append(row.astype(np.float32).tolist())
            at = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(at) for c in ("object_id", "band", "step")], pa.array(place, pa.int32()), pa.array(found, pa.list_(pa.float32()))], names=["object_id", "band", "step", "seq", "embedding"])

    out = flat.mapInArrow(run, f"object_id {kind}, band string, step int, seq int, embedding array<float>")
    return out if whole else out.drop("seq")
