"""Feature vectors, scaling, and the encoder as a batch scoring job."""

import io
import json
import math

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, functions as F, types as T

from flowspark.functions.vector import matrix
from flowspark.schema import STATISTICAL_FIELDS

FEATURES = [*STATISTICAL_FIELDS, "is_tcp", "is_udp"]

# The encoder's default shape.
DEFAULT_SHAPE = {"input_dim": 12, "hidden_dim": 64, "output_dim": 64, "num_layers": 2}

MAX_WEIGHT_BYTES = 256 << 20


def feature_columns(flows: DataFrame) -> list:
    """The 12 named features; absent values are 0.0. Takes flat or nested flows."""
    nested = "statistical" in flows.columns
    stat = (lambda f: F.col(f"statistical.{f}")) if nested else F.col
    proto = F.col("protocol.proto") if nested else F.col("proto")
    columns = [F.coalesce(stat(f), F.lit(0.0)).alias(f) for f in STATISTICAL_FIELDS]
    for name, value in (("is_tcp", "TCP"), ("is_udp", "UDP")):
        columns.append(F.coalesce((proto == value).cast("double"), F.lit(0.0)).alias(name))
    return columns


def with_features(flows: DataFrame, name="features") -> DataFrame:
    return flows.withColumn(name, F.array(*feature_columns(flows)))


def fit_scaler(flows: DataFrame) -> DataFrame:
    """One row of arrays `mean` and `scale`: population deviation, 1 where constant."""
    columns = feature_columns(flows)
    stats = flows.select(*columns).agg(
        *[F.avg(f).alias(f"m_{f}") for f in FEATURES],
        *[F.stddev_pop(f).alias(f"s_{f}") for f in FEATURES],
    )
    # A deviation that is only rounding noise counts as constant.
    def scale(f):
        noise = F.abs(F.col(f"m_{f}")) * 1e-12
        return F.when(F.col(f"s_{f}") > noise, F.col(f"s_{f}")).otherwise(1.0)

    return stats.select(
        F.array(*[F.col(f"m_{f}") for f in FEATURES]).alias("mean"),
        F.array(*[scale(f) for f in FEATURES]).alias("scale"),
    )


def scale_features(flows: DataFrame, scaler: DataFrame, name="features") -> DataFrame:
    """Standardised features; `scaler` is the one-row result of `fit_scaler`."""
    if scaler is None:
        raise ValueError("scaling needs a fitted scaler")
    # One row by construction (a global aggregate): the join moves 24 numbers.
    rows = with_features(flows, name).join(F.broadcast(scaler))
    centred = F.zip_with(name, "mean", lambda x, m: x - m)
    return rows.withColumn(name, F.zip_with(centred, "scale", lambda x, s: x / s)).drop(
        "mean", "scale"
    )


def seeded_weights(seed=42, shape=None) -> dict:
    """Random weights of the right shape, for jobs without a trained checkpoint."""
    shape = {**DEFAULT_SHAPE, **(shape or {})}
    rng = np.random.default_rng(seed)
    h, ff = shape["hidden_dim"], 2 * shape["hidden_dim"]

    def linear(rows, cols):
        bound = 1.0 / math.sqrt(cols)
        return rng.uniform(-bound, bound, (rows, cols)), rng.uniform(-bound, bound, rows)

    weights = {}

    def put(prefix, rows, cols):
        weights[f"{prefix}.weight"], weights[f"{prefix}.bias"] = linear(rows, cols)

    def norm(prefix):
        weights[f"{prefix}.weight"], weights[f"{prefix}.bias"] = np.ones(h), np.zeros(h)

    put("input_proj", h, shape["input_dim"])
    norm("input_norm")
    for i in range(shape["num_layers"]):
        layer = f"transformer.layers.{i}"
        w, b = linear(3 * h, h)
        weights[f"{layer}.self_attn.in_proj_weight"] = w
        weights[f"{layer}.self_attn.in_proj_bias"] = b
        put(f"{layer}.self_attn.out_proj", h, h)
        put(f"{layer}.linear1", ff, h)
        put(f"{layer}.linear2", h, ff)
        norm(f"{layer}.norm1")
        norm(f"{layer}.norm2")
    norm("output_norm")
    put("output_proj", shape["output_dim"], h)
    return {name: value.astype(np.float32) for name, value in weights.items()}


def save_weights(weights: dict, path: str, config=None):
    fs, location = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
    buffer = io.BytesIO()
    extra = {"config": np.array(json.dumps(config))} if config else {}
    np.savez(buffer, **weights, **extra)
    with fs.open_output_stream(location) as out:
        out.write(buffer.getvalue())


def load_weights(path: str) -> dict:
    """Weights from an `.npz`, stored bare or below `model_state_dict/` or `model/`."""
    fs, location = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
    info = fs.get_file_info(location)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(f"no weights at {path}")
    if info.size > MAX_WEIGHT_BYTES:
        raise ValueError(f"{path} is larger than weights may be")
    with fs.open_input_file(location) as source:
        stored = dict(np.load(io.BytesIO(source.read()), allow_pickle=False))
    stored.pop("config", None)
    for prefix in ("model_state_dict/", "model/"):
        inside = {k[len(prefix) :]: v for k, v in stored.items() if k.startswith(prefix)}
        if inside:
            return inside
    return stored


def parameter_count(weights: dict) -> int:
    return sum(int(v.size) for v in weights.values())


def output_dim(weights: dict) -> int:
    return int(weights["output_proj.bias"].shape[0])


def _layer_norm(x, w, name, eps=1e-5):
    centred = x - x.mean(1, keepdims=True)
    spread = np.sqrt((centred**2).mean(1, keepdims=True) + eps)
    return centred / spread * w[f"{name}.weight"] + w[f"{name}.bias"]


def _linear(x, w, name):
    return x @ w[f"{name}.weight"].T + w[f"{name}.bias"]


def _attend(x, w, layer):
    # One-step sequences: the softmax over a single key is 1, so only the value
    # projection (the last third of the joint one) and the output projection count.
    h = x.shape[1]
    value = x @ w[f"{layer}.self_attn.in_proj_weight"][2 * h :].T
    value = value + w[f"{layer}.self_attn.in_proj_bias"][2 * h :]
    return _linear(value, w, f"{layer}.self_attn.out_proj")


def _gelu(x):
    # erf by a rational approximation (Abramowitz & Stegun 7.1.26), error below 1.5e-7.
    z = np.abs(x) / math.sqrt(2.0)
    t = 1.0 / (1.0 + 0.3275911 * z)
    poly = t * (
        0.254829592
        + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))
    )
    erf = np.sign(x) * (1.0 - poly * np.exp(-z * z))
    return 0.5 * x * (1.0 + erf)


def encode(x: np.ndarray, weights: dict, variant="inference") -> np.ndarray:
    """The encoder on a matrix of feature rows.

    `inference`: norm after each sublayer, ReLU, plain output.
    `normalized`: norm before each sublayer, GELU, output of length 1.
    """
    if variant not in ("inference", "normalized"):
        raise ValueError(f"unknown encoder variant: {variant}")
    layers = len({k.split(".")[2] for k in weights if k.startswith("transformer.layers.")})
    x = _layer_norm(_linear(x, weights, "input_proj"), weights, "input_norm")
    for i in range(layers):
        layer = f"transformer.layers.{i}"
        if variant == "inference":
            x = _layer_norm(x + _attend(x, weights, layer), weights, f"{layer}.norm1")
            hidden = np.maximum(_linear(x, weights, f"{layer}.linear1"), 0.0)
            x = _layer_norm(x + _linear(hidden, weights, f"{layer}.linear2"), weights, f"{layer}.norm2")
        else:
            x = x + _attend(_layer_norm(x, weights, f"{layer}.norm1"), weights, layer)
            hidden = _gelu(_linear(_layer_norm(x, weights, f"{layer}.norm2"), weights, f"{layer}.linear1"))
            x = x + _linear(hidden, weights, f"{layer}.linear2")
    if variant == "inference":
        return _linear(_layer_norm(x, weights, "output_norm"), weights, "output_proj")
    out = _layer_norm(_linear(x, weights, "output_proj"), weights, "output_norm")
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def embed_features(df: DataFrame, weights: dict, features="features", variant="inference", name="embedding"):
    """Score every row's feature array; the other columns stay in the JVM row."""
    shared = df.sparkSession.sparkContext.broadcast(
        {k: v.astype(np.float64) for k, v in weights.items()}
    )

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def score(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=object)
        return pd.Series(list(encode(matrix(x), shared.value, variant).astype(np.float32)))

    return df.withColumn(name, score(F.col(features)))


def embed_flows(flows: DataFrame, weights: dict, scaler=None, variant="inference") -> DataFrame:
    """Flows with an `embedding`. Features are scaled only when a scaler is given."""
    rows = with_features(flows) if scaler is None else scale_features(flows, scaler)
    return embed_features(rows, weights, "features", variant).drop("features")
