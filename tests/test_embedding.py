import math

import numpy as np
import pytest
from conftest import packet

from flowspark.functions import vector as vec
from flowspark.operators import embedding as emb, flows as fl


def norm(x, gain, shift):
    mean = sum(x) / len(x)
    var = sum((v - mean) ** 2 for v in x) / len(x)
    return [(v - mean) / math.sqrt(var + 1e-5) * g + s for v, g, s in zip(x, gain, shift)]


def dense(w, name, x):
    return [sum(a * b for a, b in zip(row, x)) + bias for row, bias in zip(w[f"{name}.weight"], w[f"{name}.bias"])]


def by_hand(x, w, variant):
    """One row through the encoder, number by number."""
    h = norm(dense(w, "input_proj", x), w["input_norm.weight"], w["input_norm.bias"])
    n = len(h)
    for i in range(2):
        p = f"transformer.layers.{i}."
        ln = lambda v, which: norm(v, w[f"{p}{which}.weight"], w[f"{p}{which}.bias"])

        def attend(v):
            rows = w[p + "self_attn.in_proj_weight"][2 * n :]
            bias = w[p + "self_attn.in_proj_bias"][2 * n :]
            value = [sum(a * b for a, b in zip(row, v)) + c for row, c in zip(rows, bias)]
            return dense(w, p + "self_attn.out_proj", value)

        def feed(v):
            hidden = dense(w, p + "linear1", v)
            if variant == "inference":
                hidden = [max(0.0, z) for z in hidden]
            else:
                hidden = [0.5 * z * (1 + math.erf(z / math.sqrt(2))) for z in hidden]
            return dense(w, p + "linear2", hidden)

        add = lambda a, b: [s + t for s, t in zip(a, b)]
        if variant == "inference":
            h = ln(add(h, attend(h)), "norm1")
            h = ln(add(h, feed(h)), "norm2")
        else:
            h = add(h, attend(ln(h, "norm1")))
            h = add(h, feed(ln(h, "norm2")))
    if variant == "inference":
        return dense(w, "output_proj", norm(h, w["output_norm.weight"], w["output_norm.bias"]))
    out = norm(dense(w, "output_proj", h), w["output_norm.weight"], w["output_norm.bias"])
    length = math.sqrt(sum(v * v for v in out))
    return [v / length for v in out]


@pytest.mark.parametrize("variant", ["inference", "normalized"])
def test_encoder_by_hand(variant):
    w = {k: v.astype(float) for k, v in emb.seeded_weights(1).items()}
    x = [0.3 * i - 1 for i in range(12)]
    assert emb.encode(np.array([x]), w, variant)[0] == pytest.approx(by_hand(x, w, variant), abs=1e-5)


def test_parameter_count():
    assert emb.parameter_count(emb.seeded_weights()) == 72_192


def flows(packets):
    rows = [packet(i, i * 1000, "1.1.1.1", f"2.2.2.{i % 4}", 6 if i % 4 else 17, 5, 6, 60 + i) for i in range(20)]
    return fl.flow_table(packets(rows))


def test_embeddings_do_not_depend_on_batches(packets):
    w = emb.seeded_weights()
    df = emb.embed_flows(flows(packets), w)
    rows = {r.first_seq: r.embedding for r in df.collect()}
    assert len(rows) == 4 and all(len(v) == 64 for v in rows.values())
    one = emb.embed_flows(flows(packets).where("first_seq = 2"), w).first()
    assert one.embedding == pytest.approx(rows[2], abs=1e-5)
    assert emb.embed_flows(flows(packets).limit(0), w).count() == 0


def test_weight_files(tmp_path):
    w = emb.seeded_weights(7)
    for prefix in ("", "model/", "model_state_dict/"):
        path = str(tmp_path / f"w{len(prefix)}.npz")
        emb.save_weights({prefix + k: v for k, v in w.items()}, path, {"input_dim": 12})
        got = emb.load_weights(path)
        assert got.keys() == w.keys() and all((got[k] == w[k]).all() for k in w)
    with pytest.raises(FileNotFoundError):
        emb.load_weights(str(tmp_path / "none.npz"))
    with pytest.raises(ValueError):
        emb.encode(np.zeros((1, 12)), w, "other")


def test_scaling(packets):
    df = flows(packets)
    scaled = emb.scale_features(df, emb.fit_scaler(df)).collect()
    x = np.array([r.features for r in scaled])
    assert x.mean(0) == pytest.approx(np.zeros(12), abs=1e-9)
    varied = x.std(0) > 0.5
    assert x.std(0)[varied] == pytest.approx(1.0) and (x[:, ~varied] == 0).all()
    with pytest.raises(ValueError):
        emb.scale_features(df, None)


def test_vector_functions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, b array<double>")
    row = df.select(
        vec.l2_squared("a", "b"), vec.euclidean("a", "b"), vec.l2_normalized("a"), vec.l2_normalized("b")
    ).first()
    assert list(row) == [25.0, 5.0, [0.6, 0.8], [0.0, 0.0]]
